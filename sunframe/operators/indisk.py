"""Best rows inside many disks when the ranking belongs to the rows alone.

A disk is cut into grid cells: a cell wholly inside contributes its own best ``k`` rows, prepared
once per cell, and only the small cells on the rim are looked at row by row. The work per disk
follows its rim, not the number of rows inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, lat_reach, lon_reach
from ..session import materialize
from .radius import MAX_LEVEL, WORLD_DEG, level_for
from .series import top_k_per_key

RIM_ROWS = 500


def top_in_disks(disks: DataFrame, points: DataFrame, disk_at: tuple[str, str], radius: str,
                 point_at: tuple[str, str], ranking: list[Column], k: int, rim_rows: int = RIM_ROWS) -> DataFrame:
    """Distinct disks (latitude, longitude, radius) with their best ``k`` points by ``ranking``."""
    key = [*disk_at, radius]
    spots = materialize(disks.select(*key).distinct(), "disks")
    # of equal places only the best k can be chosen
    kept = materialize(top_k_per_key(points, list(point_at), ranking, k), "disk-points")
    top = spots.agg(F.min(level_for(F.col(radius), 1.0))).first()[0]
    if top is None:
        return spots.join(kept, F.lit(False))
    leaf = min(MAX_LEVEL, top + 2)
    while leaf < MAX_LEVEL and (kept.groupBy(*_cells(point_at, leaf)).count().agg(F.max("count")).first()[0] or 0) > rim_rows:
        leaf += 1
    levels = list(range(top, leaf + 1))

    placed = kept.withColumn("_at", F.explode(F.array(*[
        F.struct(F.lit(v).alias("level"), *[c.alias(n) for c, n in zip(_cells(point_at, v), ("x", "y"))])
        for v in levels]))).select(*kept.columns, "_at.*")
    best = top_k_per_key(placed, ["level", "x", "y"], ranking, k)

    whole, rim = _cover(spots, disk_at, radius, levels)
    inside = whole.join(best, ["level", "x", "y"]).drop("level", "x", "y")
    edge = rim.join(placed.where(F.col("level") == leaf), ["level", "x", "y"]).drop("level", "x", "y")
    km = haversine_km(F.col(point_at[0]), F.col(point_at[1]), F.col(disk_at[0]), F.col(disk_at[1]))
    found = inside.unionByName(edge).withColumn("distance_km", km).where(F.col("distance_km") <= F.col(radius))
    return top_k_per_key(found, key, ranking, k)


def _cells(at: tuple[str, str], level: int) -> tuple[Column, Column]:
    width = WORLD_DEG / 2 ** level
    return F.pmod(F.floor(F.col(at[1]) / width), F.lit(2 ** level)), F.floor(F.col(at[0]) / width)


def _cover(spots: DataFrame, at: tuple[str, str], radius: str, levels: list[int]) -> tuple[DataFrame, DataFrame]:
    """(cells wholly inside, smallest cells on the rim) of every disk."""
    lat, lon, r = F.col(at[0]), F.col(at[1]), F.col(radius)
    width = WORLD_DEG / 2 ** levels[0]
    n = F.lit(2 ** levels[0]).cast("long")
    up, out = lat_reach(r), lon_reach(lat, r)
    xs = F.when(out * 2 + width >= WORLD_DEG, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.floor((lon - out) / width), F.floor((lon + out) / width)),
                                     lambda x: F.pmod(x, n))))
    ys = F.sequence(F.floor((lat - up) / width), F.floor((lat + up) / width))
    open_ = spots.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
    whole = None
    for level in levels:
        w = WORLD_DEG / 2 ** level
        cy, cx = (F.col("y") + 0.5) * w, (F.col("x") + 0.5) * w
        span = F.greatest(*[haversine_km(cy, cx, cy + s * w / 2, cx + F.lit(w / 2)) for s in (-1, 1)]) * (1 + 1e-9)
        centre = haversine_km(lat, lon, cy, cx)
        rated = open_.withColumns({"_near": centre - span, "_far": centre + span}).where(F.col("_near") <= r)
        if level == levels[-1]:
            full = rated.where(F.col("_far") <= r)
            rim = rated.where(F.col("_far") > r).withColumn("level", F.lit(level)).drop("_near", "_far")
        else:
            rated = materialize(rated, "cells")  # both outcomes read it
            full = rated.where(F.col("_far") <= r)
            quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
            open_ = rated.where(F.col("_far") > r).drop("_near", "_far").withColumn("_q", quarter).withColumns(
                {"x": F.col("x") * 2 + F.col("_q.i"), "y": F.col("y") * 2 + F.col("_q.j")}).drop("_q")
        part = full.withColumn("level", F.lit(level)).drop("_near", "_far")
        whole = part if whole is None else whole.unionByName(part)
    return whole, rim
