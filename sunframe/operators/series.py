"""Row-ordered windows over keyed series that stay exact when one series is huge.

A series is all rows of one key in time order. Short series use one plain window. When a key
holds more than ``block_rows`` rows its rows are numbered with a two-level count (per key and
clock bucket, then within the bucket) and cut into blocks of consecutive rows. A block receives
copies of the few neighbouring rows a frame reaches into, so no task ever holds a whole long key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_ROW, _BLOCK, _HOME = "_sf_row", "_sf_block", "_sf_home"


@dataclass(frozen=True)
class SeriesOrder:
    """Key columns, time column and tiebreak of a table of series.

    ``long`` says whether some key exceeds ``block_rows``; ``None`` means count first, which also sets ``tasks``, twice the
    number of blocks.
    """

    keys: tuple[str, ...]
    ts: str
    tiebreak: tuple[str, ...] = ()
    block_rows: int = 100_000
    grain: str = "hour"
    long: bool | None = None
    tasks: int | None = None

    def plain_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts, *self.tiebreak)

    def backward_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.desc(self.ts), *[F.desc(c) for c in self.tiebreak])

    def resolve(self, df: DataFrame) -> "SeriesOrder":
        """Decide once, from a pre-aggregated row count per key."""
        if self.long is not None:
            return self
        top, rows = df.groupBy(*self.keys).count().agg(F.max("count"), F.sum("count")).first()
        return replace(self, long=(top or 0) > self.block_rows, tasks=2 * (rows or 0) // self.block_rows + 1)


def number_rows(df: DataFrame, order: SeriesOrder, name: str = _ROW) -> DataFrame:
    """Dense 1-based row number per key, without a task per key.

    Counting per (key, clock bucket) is combined map-side; the running total over a key's
    buckets grows with calendar time, not with rows.
    """
    clock, before = "_sf_clock", "_sf_before"
    grouped = [*order.keys, clock]
    df = df.withColumn(clock, F.date_trunc(order.grain, order.ts))
    totals = Window.partitionBy(*order.keys).orderBy(clock)
    offsets = (
        df.groupBy(*grouped).count()
        .withColumn(before, F.sum("count").over(totals) - F.col("count"))
        .select(*[F.col(c).alias(f"_o_{c}") for c in grouped], before)
    )
    match = [df[c].eqNullSafe(offsets[f"_o_{c}"]) for c in grouped]
    joined = df.join(offsets, match).drop(*[f"_o_{c}" for c in grouped])
    inside = Window.partitionBy(*grouped).orderBy(order.ts, *order.tiebreak)
    return joined.withColumn(name, F.row_number().over(inside) + F.col(before)).drop(clock, before)


def by_block(df: DataFrame, order: SeriesOrder) -> DataFrame:
    """Few blocks a task, however many there are; left to themselves, tasks would take many and sort them as one."""
    return df.repartition(*([order.tasks] if order.tasks else []), *order.keys, _BLOCK)


def windowed(
    df: DataFrame,
    order: SeriesOrder,
    build: Callable[[WindowSpec], dict[str, Column]] | list[Callable[[WindowSpec], dict[str, Column]]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add columns computed over the ordered series.

    ``build`` gets the ordered window and returns the new columns; several builders run one after
    the other on one shuffle and sort. Their frames together may reach no more than ``before``
    rows back or ``after`` rows ahead.
    """
    order = order.resolve(df)
    stages = build if isinstance(build, list) else [build]

    def run(rows: DataFrame, window: WindowSpec) -> DataFrame:
        for stage in stages:
            added = stage(window)
            rows = rows.withColumns(added) if added else rows
        return rows

    if not order.long:
        return run(df, order.plain_window())
    numbered = number_rows(df, order)
    size = F.lit(order.block_rows)
    zero_based = F.col(_ROW) - 1
    first = F.floor((zero_based - after) / size)
    last = F.floor((zero_based + before) / size)
    spread = (
        numbered.withColumn(_HOME, F.floor(zero_based / size))
        .withColumn(_BLOCK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    )
    spread = by_block(spread, order)
    window = Window.partitionBy(*order.keys, _BLOCK).orderBy(_ROW)
    return (
        run(spread, window)
        .where(F.col(_BLOCK) == F.col(_HOME))
        .drop(_ROW, _BLOCK, _HOME)
    )


def neighbours(df: DataFrame, order: SeriesOrder, columns: list[str]) -> DataFrame:
    """For each column the nearest non-null value at or before a row and at or after it.

    Adds ``{c}_prev``/``{c}_next`` structs (row, value) and ``_sf_row``. Reaches any distance:
    on long series each block is summarised by its first and last known value, and only those
    summaries travel between blocks.
    """
    order = order.resolve(df)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(_ROW).alias("row"), F.col(c).alias("value")))

    def around(forward: WindowSpec, backward: WindowSpec) -> dict[str, Column]:
        # looking ahead runs over the reversed order: a frame that reaches to the end of the
        # partition would be evaluated anew for every row
        out = {}
        for c in columns:
            out[f"{c}_prev"] = F.last(known(c), ignorenulls=True).over(
                forward.rowsBetween(Window.unboundedPreceding, 0))
            out[f"{c}_next"] = F.last(known(c), ignorenulls=True).over(
                backward.rowsBetween(Window.unboundedPreceding, 0))
        return out

    if not order.long:
        numbered = df.withColumn(_ROW, F.row_number().over(order.plain_window()).cast("long"))
        return numbered.withColumns(around(order.plain_window(), order.backward_window()))

    blocked = number_rows(df, order).withColumn(
        _BLOCK, F.floor((F.col(_ROW) - 1) / F.lit(order.block_rows)))
    grouped = [*order.keys, _BLOCK]
    edges = blocked.groupBy(*grouped).agg(*[
        agg for c in columns for agg in (
            F.max_by(known(c), F.when(F.col(c).isNotNull(), F.col(_ROW))).alias(f"_last_{c}"),
            F.min_by(known(c), F.when(F.col(c).isNotNull(), F.col(_ROW))).alias(f"_first_{c}"),
        )
    ])
    blocks = Window.partitionBy(*order.keys)
    back = blocks.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *[F.col(g).alias(f"_o_{g}") for g in grouped],
        *[F.last(f"_last_{c}", ignorenulls=True).over(back).alias(f"_carry_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(ahead).alias(f"_ahead_{c}") for c in columns],
    )
    match = [blocked[g].eqNullSafe(carried[f"_o_{g}"]) for g in grouped]
    joined = by_block(blocked.join(carried, match), order)
    window = Window.partitionBy(*grouped)
    filled = joined.withColumns(around(window.orderBy(_ROW), window.orderBy(F.desc(_ROW))))
    for c in columns:
        filled = filled.withColumns({
            f"{c}_prev": F.coalesce(f"{c}_prev", f"_carry_{c}"),
            f"{c}_next": F.coalesce(f"{c}_next", f"_ahead_{c}"),
        })
    return filled.drop(
        _BLOCK, *[f"_o_{g}" for g in grouped],
        *[f"_carry_{c}" for c in columns], *[f"_ahead_{c}" for c in columns])


def top_k_per_key(df: DataFrame, keys: list[str], ranking: list[Column], k: int,
                  rank_col: str | None = None) -> DataFrame:
    """Best ``k`` rows per key. Each task keeps only its own best ``k`` before the shuffle."""
    name = rank_col or "_sf_rank"
    ranked = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking)).cast("long"))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank_col else kept.drop(name)
