"""Exact k-nearest joins by widening grids.

Copies of one spot are collapsed to their ``k`` lowest ids first. Cells start narrow enough that
none is crowded and double every round; a query leaves as soon as its k-th neighbour is closer
than anything outside its block of cells can be. Crowded regions are settled while cells are
narrow, so no group of rows is ever paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, KM_PER_DEGREE, haversine_km, planar_km
from ..session import materialize

CELL_ROWS = 500


def nearest_k(
    queries: DataFrame, donors: DataFrame, query_at: list[str], donor_at: list[str], donor_id: str,
    k: int, distance: Column, outside: Callable[[float], Column],
    within: Column | None = None, period: list[float | None] | None = None,
    cell_rows: int = CELL_ROWS, same: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """Distinct query spots joined to their ``k`` nearest donors.

    ``distance`` compares a query with a donor, ``outside(width)`` bounds from below the distance
    of every donor outside the 3^d block of cells of that width, ``within`` is the largest
    distance of interest (a query column), ``period`` the wrap-around of each coordinate and
    ``same`` lists (query, donor) columns that must be equal. Result: query columns, donor columns and ``_distance``; ties go to the lower donor id.
    """
    dims = range(len(query_at))
    period = period or [None] * len(query_at)
    qs = queries.columns
    copies = Window.partitionBy(*donor_at, *[d for _, d in same]).orderBy(donor_id)
    donors = materialize(donors.withColumn("_copy", F.row_number().over(copies))
                         .where(F.col("_copy") <= k).drop("_copy"), "nearest-donors")
    rest = materialize(queries.distinct(), "nearest-queries")
    aggs = [f(F.col(c)) for c in donor_at for f in (F.min, F.max)]
    low_high = donors.agg(*aggs).first()
    asked = rest.agg(*[f(F.col(c)) for c in query_at for f in (F.min, F.max)]).first()
    if low_high[0] is None or asked[0] is None:
        return rest.join(donors, F.lit(False))
    span = max([max(low_high[2 * i + 1], asked[2 * i + 1]) - min(low_high[2 * i], asked[2 * i])
                for i in dims] + [1e-9])
    periods = [p for p in period if p]
    base = periods[0] if periods else span
    level = max(0, math.floor(math.log2(base / span)))

    def cells(columns: list[str], width: float) -> list[Column]:
        return [F.floor(F.col(c) / width) for c in columns]

    for _ in range(40):
        crowded = donors.groupBy(*[d for _, d in same], *cells(donor_at, base / 2 ** level)).count().agg(
            F.max("count")).first()[0]
        if crowded <= cell_rows:
            break
        level += 1
    best = Window.partitionBy(*qs).orderBy("_distance", donor_id)
    everyone = Window.partitionBy(*qs)
    keys = [f"_cell{i}" for i in dims]
    settled = []
    while True:
        width = base / 2 ** level
        last = level <= 0 or (not periods and width >= span)
        placed, around = donors, rest
        for i, key in enumerate(keys):
            there, here = F.floor(F.col(donor_at[i]) / width), F.floor(F.col(query_at[i]) / width)
            block = F.sequence(here - 1, here + 1)
            if period[i]:
                around_world = F.lit(round(period[i] / width))
                there = F.pmod(there, around_world)
                block = F.array_distinct(_wrapped(block, around_world))
            placed, around = placed.withColumn(key, there), around.withColumn(key, F.explode(block))
        placed = placed.withColumnsRenamed({key: f"{key}_there" for key in keys})
        match = [around[key] == placed[f"{key}_there"] for key in keys] + [around[q] == placed[d] for q, d in same]
        # a query is nine rows by now, which Spark's sizes do not show: it may not be broadcast
        near = around.join(placed.hint("merge"), match).drop(*keys, *[f"{key}_there" for key in keys]).withColumn("_distance", distance)
        near = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
        if last:
            sure = F.lit(True)
        else:
            sure = (F.count("*").over(everyone) == k) & (F.max("_distance").over(everyone) < outside(width))
            if within is not None:
                sure = sure | (outside(width) > within)
        done = materialize(near.withColumn("_sure", sure).where("_sure").drop("_sure", "_rank"), "nearest-done")
        settled.append(done)
        if last:
            break
        finished = done.select(*qs).distinct()
        if within is not None:  # queries with nothing in reach leave as well
            rest = rest.where(outside(width) <= within)
        rest = materialize(rest.join(finished, qs, "left_anti"), "nearest-open")
        if rest.isEmpty():
            break
        level -= 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out if within is None else out.where(F.col("_distance") <= within)


def _wrapped(cells: Column, count: Column) -> Column:
    return F.transform(cells, lambda x: F.pmod(x, count))


def nearest_on_globe(
    queries: DataFrame, donors: DataFrame, query_at: tuple[str, str], donor_at: tuple[str, str],
    donor_id: str, k: int, within: Column | None = None, decimals: int | None = None,
    cell_rows: int = CELL_ROWS, same: tuple[tuple[str, str], ...] = (), planar: bool = False,
) -> DataFrame:
    """The ``k`` nearest donors in km; ``decimals`` ranks by the rounded distance.

    ``planar`` measures in degrees times 111 km.
    """
    if planar:
        flat = planar_km(F.col(query_at[0]), F.col(query_at[1]), F.col(donor_at[0]), F.col(donor_at[1]))
        return nearest_k(queries, donors, list(query_at), list(donor_at), donor_id, k, flat,
                         lambda width: F.lit(width * KM_PER_DEGREE * (1 - 1e-9)), within, None, cell_rows, same)
    km = haversine_km(F.col(query_at[0]), F.col(query_at[1]), F.col(donor_at[0]), F.col(donor_at[1]))
    slack = 0.0
    if decimals is not None:
        km, slack = F.round(km, decimals), 10.0 ** -decimals

    def outside(width: float) -> Column:
        half = F.radians(F.lit(width)) / 2
        edge = F.least(F.lit(90.0), F.abs(F.col(query_at[0])) + width)
        east_west = F.asin(F.cos(F.radians(edge)) * F.sin(F.least(half, F.lit(1.5)))) * (2 * EARTH_RADIUS_KM)
        return F.least(F.radians(F.lit(width)) * EARTH_RADIUS_KM, east_west) * (1 - 1e-9) - slack

    return nearest_k(queries, donors, list(query_at), list(donor_at), donor_id, k, km, outside, within,
                     [None, 360.0], cell_rows, same)
