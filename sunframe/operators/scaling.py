"""Column scaling: fitted once, stored, applied as constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import quantile_table


@dataclass(frozen=True)
class Scaler:
    """Centre and scale per column; a zero scale divides by one."""

    method: str
    centre: dict[str, float]
    scale: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], method: str = "standard") -> "Scaler":
        """standard: mean and population deviation; minmax: 0..1; robust: median and quartiles."""
        if method == "robust":
            q = quantile_table(df, columns, [0.25, 0.5, 0.75])
            pairs = {c: (v[0.5], v[0.75] - v[0.25]) for c, v in q.items() if v}
        elif method in ("standard", "minmax"):
            first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
            row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns)
                           for f, n in ((first, "a"), (second, "b"))]).first()
            pairs = {}
            for i, c in enumerate(columns):
                a, b = row[f"a{i}"], row[f"b{i}"]
                if a is not None:
                    pairs[c] = (a, b if method == "standard" else b - a)
        else:
            raise ValueError(f"unknown scaling method: {method}")
        return Scaler(method, {c: p[0] for c, p in pairs.items()},
                      {c: p[1] if p[1] else 1.0 for c, p in pairs.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.scale[c])
            for c in self.centre if c in df.columns})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.method, c, self.centre[c], self.scale[c]) for c in self.centre]
        spark.createDataFrame(rows, "method string, column string, centre double, scale double"
                              ).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scaler":
        rows = spark.read.parquet(path).collect()
        return Scaler(rows[0]["method"], {r["column"]: r["centre"] for r in rows},
                      {r["column"]: r["scale"] for r in rows})
