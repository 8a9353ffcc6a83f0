"""Exact quantiles and global ranks without sorting a whole column in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _long_form(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_cell")
    return (
        df.select(*by, cells)
        .select(*by, "_cell.column", "_cell.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


GRID = 32
MOST_INSIDE = 50_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
    accuracy: int = 100_000, most_inside: int = MOST_INSIDE,
) -> DataFrame:
    """Linearly interpolated quantiles, exact: rows (by.., column, prob, value).

    A mergeable sketch brackets every wanted rank. A bracket that may hold more than ``most_inside`` values is narrowed by
    another sketch of what is inside it, as often as it takes. Then one pass counts what lies
    below and the distinct values inside, combined map-side, with the nearest value on either side; only those few are
    ever ordered. A bracket that misses its rank after all starts over with the whole range. All
    sizes of groups go the same way.
    """
    by = by or []
    group = [*by, "column"]
    values = _long_form(df, columns, by)
    margin = 4.0 / accuracy
    probes = [p for q in probs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = values.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.percentile_approx("value", F.array(*[F.lit(p) for p in probes]), accuracy).alias("probes"),
    )
    brackets = sketch.select(*[F.col(g).alias(f"_b_{g}") for g in group], "n", "least", "most", F.explode(F.array(*[
        F.struct(
            F.lit(float(q)).alias("prob"),
            (F.lit(float(q)) * (F.col("n") - 1)).alias("position"),
            F.col("probes")[2 * i].alias("low"), F.col("probes")[2 * i + 1].alias("high"),
            (F.col("n") * (2 * margin + 2.0 / accuracy)).alias("room"),
        ) for i, q in enumerate(probs)
    ])).alias("b")).select(*[f"_b_{g}" for g in group], "n", "least", "most", "b.*")
    # a written table, whose size tells Spark whether the values have to be shuffled to meet it
    brackets = _narrow_enough(values, materialize(brackets, "quantile-brackets"), group, accuracy, most_inside)
    found = materialize(_picked(values, brackets, group), "quantiles")
    missed = found.where(F.col("value").isNull()).select(*[F.col(g).alias(f"_m_{g}") for g in group], F.col("prob").alias("_m_prob"))
    if missed.isEmpty():
        return found
    again = brackets.join(missed, [F.col(f"_b_{g}").eqNullSafe(F.col(f"_m_{g}")) for g in group] + [F.col("prob") == F.col("_m_prob")], "left_semi")
    again = again.withColumns({"low": F.col("least"), "high": F.col("most"), "room": F.col("n").cast("double")})
    again = _narrow_enough(values, materialize(again, "quantile-brackets"), group, accuracy, most_inside)
    return found.where(F.col("value").isNotNull()).unionByName(_picked(values, again, group))


def _met(values: DataFrame, brackets: DataFrame, group: list[str]) -> DataFrame:
    return values.join(brackets, [values[g].eqNullSafe(brackets[f"_b_{g}"]) for g in group])


def _narrow_enough(values: DataFrame, brackets: DataFrame, group: list[str], accuracy: int, most_inside: int) -> DataFrame:
    """Brackets narrowed until none has room for more values; one that a single value fills is narrow."""
    done = []
    while True:
        wide = brackets.where(F.col("room") > most_inside)
        if wide.isEmpty():
            break
        done.append(brackets.where(F.col("room") <= most_inside))
        keys = [c for c in wide.columns if c != "room"]
        v, inside = F.col("value"), F.col("value").between(F.col("low"), F.col("high"))
        counted = _met(values, wide, group).groupBy(*keys).agg(
            F.count_if(v < F.col("low")).alias("_below"), F.count_if(inside).alias("_inside"),
            F.percentile_approx(F.when(inside, v), F.array(*[F.lit(i / GRID) for i in range(1, GRID)]), accuracy).alias("_grid"))
        # one step of the grid to spare on either side
        first = F.floor((F.floor("position") - F.col("_below")) / F.col("_inside") * GRID).cast("int") - 1
        last = F.ceil((F.ceil("position") + 1 - F.col("_below")) / F.col("_inside") * GRID).cast("int") + 1
        low = F.when(first >= 1, F.get("_grid", F.least(first, F.lit(GRID - 1)) - 1)).otherwise(F.col("low"))
        high = F.when(last < GRID, F.get("_grid", F.greatest(last, F.lit(1)) - 1)).otherwise(F.col("high"))
        stuck = (F.col("_low") == F.col("low")) & (F.col("_high") == F.col("high"))
        room = F.when(stuck | (F.col("_low") == F.col("_high")), 0.0).otherwise(
            F.col("_inside") * (F.least(last, F.lit(GRID)) - F.greatest(first, F.lit(0)) + 1) / GRID)
        narrowed = counted.withColumns({"_low": low, "_high": high}).withColumn("room", room)
        brackets = materialize(narrowed.withColumns({"low": F.col("_low"), "high": F.col("_high")}).select(*keys, "room"), "quantile-brackets")
    out = brackets
    for part in done:
        out = out.unionByName(part)
    return out


def _picked(values: DataFrame, brackets: DataFrame, group: list[str]) -> DataFrame:
    """The interpolated value of each bracket; NULL where its ranks lie further outside than the next value."""
    v = F.col("value")
    side = F.when(v < F.col("low"), -1).when(v > F.col("high"), 1).otherwise(0)
    keys = [*group, "prob", "position"]
    counted = (_met(values, brackets, group).withColumn("side", side)
               .groupBy(*keys, "side", F.when(F.col("side") == 0, v).alias("inner"))
               .agg(F.count("*").alias("rows"), F.min("value").alias("bottom"), F.max("value").alias("top")))
    running = Window.partitionBy(*group, "prob").orderBy("side", "inner").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("rows").over(running))

    def first_at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.struct("side", "inner", "upto", "rows", "bottom", "top")))

    def value(hit: str, rank: Column) -> Column:
        x = F.col(hit)
        return (F.when(x["side"] == 0, x["inner"]).when((x["side"] == -1) & (rank == x["upto"] - 1), x["top"])
                .when((x["side"] == 1) & (rank == x["upto"] - x["rows"]), x["bottom"]))

    hits = ranked.groupBy(*keys).agg(first_at(F.floor("position")).alias("_lower"), first_at(F.ceil("position")).alias("_upper"))
    lower, upper = value("_lower", F.floor("position")), value("_upper", F.ceil("position"))
    share = F.col("position") - F.floor("position")
    return hits.select(*group, "prob", (lower + (upper - lower) * share).alias("value"))


def quantile_table(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, dict[float, float]]:
    """Whole-column quantiles as numbers; columns x probs values, bounded by the call."""
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for row in exact_quantiles(df, columns, probs).collect():
        out[row["column"]][row["prob"]] = row["value"]
    return out


def with_range_bucket(df: DataFrame, column: str, buckets: int = 512, name: str = "_sf_bucket") -> DataFrame:
    """A bucket number that follows the order of ``column``, with about equal rows per bucket."""
    cuts = df.where(F.col(column).isNotNull()).approxQuantile(
        column, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def running_total(
    df: DataFrame, column: str, amounts: list[str], by: list[str] | None = None,
) -> DataFrame:
    """``{amount}_before``: sum of ``amount`` over all rows with a smaller ``column``.

    ``df`` must hold one row per (by, column). Bucket totals are summed first, so the ordered
    windows see one bucket, or one row per bucket, but never the whole table.
    """
    by = by or []
    bucketed = with_range_bucket(df, column)
    totals = bucketed.groupBy(*by, "_sf_bucket").agg(*[F.sum(a).alias(f"_t_{a}") for a in amounts])
    over = Window.partitionBy(*by).orderBy("_sf_bucket") if by else Window.orderBy("_sf_bucket")
    offsets = totals.select(
        *[F.col(g).alias(f"_o_{g}") for g in [*by, "_sf_bucket"]],
        *[(F.sum(f"_t_{a}").over(over) - F.col(f"_t_{a}")).alias(f"_p_{a}") for a in amounts])
    offsets = materialize(offsets, "bucket-offsets") if by else F.broadcast(offsets)  # one row per bucket
    match = [bucketed[g].eqNullSafe(offsets[f"_o_{g}"]) for g in [*by, "_sf_bucket"]]
    inside = Window.partitionBy(*by, "_sf_bucket").orderBy(column)
    joined = bucketed.join(offsets, match)
    for a in amounts:
        joined = joined.withColumn(
            f"{a}_before", F.sum(a).over(inside) - F.col(a) + F.col(f"_p_{a}"))
    return joined.drop("_sf_bucket", *[f"_o_{g}" for g in [*by, "_sf_bucket"]],
                       *[f"_p_{a}" for a in amounts])
