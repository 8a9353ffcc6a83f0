"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Rows reach their trees by hash, each tree is grown from at most ``sample`` rows in its own group,
and the finished forest, whose size depends on the parameters only, scores every row in place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantile_table

_NODES = "tree long, node long, feature long, threshold double, left long, right long, path double"


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    grown = 2 * (np.log(np.maximum(safe - 1, 1)) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, tree: int, seed: int, max_depth: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree])
    nodes: list[tuple] = []
    queue = [(np.arange(len(rows)), 0)]
    next_id = 1
    while queue:
        members, depth = queue.pop(0)
        node = len(nodes)
        part = rows[members]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
        if depth >= max_depth or len(members) <= 1 or not len(spread):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(_mean_path(len(members)))))
            continue
        feature = int(rng.choice(spread))
        cut = rng.uniform(part[:, feature].min(), part[:, feature].max())
        below = part[:, feature] <= cut
        nodes.append((tree, node, feature, cut, next_id, next_id + 1, 0.0))
        next_id += 2
        queue += [(members[below], depth + 1), (members[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])


@dataclass(frozen=True)
class IsolationForest:
    """A grown forest; arrays of nodes per tree."""

    features: tuple[str, ...]
    means: dict[str, float]
    trees: tuple[dict[str, np.ndarray], ...]
    sample: int

    @staticmethod
    def fit(df: DataFrame, row_id: str, features: list[str], trees: int = 100, sample: int = 256,
            seed: int = 42) -> "IsolationForest":
        stats = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
        means = {c: stats[f"m{i}"] or 0.0 for i, c in enumerate(features)}
        n = max(stats["n"], 1)
        wanted = trees * sample
        share = min(1.0, 2.0 * wanted / n)
        copies = int(min(trees, np.ceil(2.0 * wanted / (n * share))))
        spot = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1 << 30))
        pool = df.where(spot < int(share * (1 << 30))) if share < 1 else df
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in features]
        placed = pool.select(row_id, *filled, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_j"))
        placed = placed.withColumn(
            "tree", F.pmod(F.xxhash64(F.col(row_id), F.col("_j"), F.lit(seed)), F.lit(trees)).cast("long"))
        placed = placed.dropDuplicates([row_id, "tree"])
        order = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(row_id), F.col("tree"), F.lit(seed)), row_id)
        drawn = placed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample)
        depth = int(np.ceil(np.log2(max(sample, 2))))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rank")
            return _grow(pdf[features].to_numpy(), int(pdf["tree"].iloc[0]), seed, depth)

        # trees x (2 * sample - 1) nodes at most
        nodes = drawn.groupBy("tree").applyInPandas(build, _NODES).toPandas()
        grown = tuple(
            {c: part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")}
            for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"))
        return IsolationForest(tuple(features), means, grown, int(min(sample, n)))

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Adds 2 ** (-mean path / expected path); near 1 is anomalous."""
        forest, norm = self.trees, float(_mean_path(self.sample))

        @F.pandas_udf("double")
        def rate(*cols: pd.Series) -> pd.Series:
            rows = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            where = np.arange(len(rows))
            total = np.zeros(len(rows))
            for tree in forest:
                at = np.zeros(len(rows), dtype=np.int64)
                while True:
                    feature = tree["feature"][at]
                    open_ = feature >= 0
                    if not open_.any():
                        break
                    go_left = rows[where, np.maximum(feature, 0)] <= tree["threshold"][at]
                    step = np.where(go_left, tree["left"][at], tree["right"][at])
                    at = np.where(open_, step, at)
                total += tree["path"][at]
            return pd.Series(np.power(2.0, -total / len(forest) / max(norm, 1e-9)))

        inputs = [F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])) for c in self.features]
        return df.withColumn(name, rate(*inputs))


def flag_anomalies(scored: DataFrame, contamination: float = 0.05, score: str = "anomaly_score") -> DataFrame:
    """``is_anomaly`` for the top share of scores and the score scaled to 0..1.

    ``scored`` is read three times: write it out first when scoring is costly.
    """
    bar = quantile_table(scored, [score], [1 - contamination])[score][1 - contamination]
    ends = scored.agg(F.min(score), F.max(score)).first()
    return scored.withColumns({
        "is_anomaly": (F.col(score) > bar).cast("int"),
        "normal_score": (F.col(score) - ends[0]) / (ends[1] - ends[0] + 1e-6),
    })


def drop_anomalies(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Only the rows that are not flagged."""
    return flag_anomalies(scored, contamination).where(F.col("is_anomaly") == 0).drop(
        "is_anomaly", "normal_score", "anomaly_score")
