"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_dir

#: Fixed: a word is a maximal run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one job in the shared folder; ``drop`` removes one that no later step reads.

    What is still needed when the result is read stays until the application ends (``deleteOnExit``).
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_dir(spark, label)
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
        """Write ``df`` and read it back: later passes start from files, a lost executor costs one task."""
        path = os.path.join(self.root, name)
        df.write.option("compression", compression).options(**options).parquet(path)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A saved table anew, with columns of its own: for joins of a table with what was made of it."""
        return self.spark.read.parquet(os.path.join(self.root, name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = os.path.join(self.root, name)
            self._fs(path).delete(self._path(path), True)


def with_fields(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` and further fields."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in types.items()]])


def unit_hash(*columns: Column) -> Column:
    """63 bits of a hash, never negative: an order that reruns repeat."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def numbered_slices(df: DataFrame, key: str, hashed: str, value: Column, into: str,
                    counts: DataFrame) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the same key that come before, in order of ``hashed``.

    A key of n rows is cut at equal hash steps into about sqrt(n) slices, so neither the rows of a slice nor
    the slices of a key make a long window, however hot the key is. ``counts`` has one row per key with the
    column ``n_rows``; NULL is a key of its own. Rows that tie on the hash take the order of the value.
    """
    counts = counts.select(F.col(key).alias("__key"), F.ceil(F.sqrt("n_rows")).alias("__slices"))
    cut = (df.withColumn("__value", value)
           .join(counts, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
           .withColumn("__slice", F.floor(F.col(hashed) / F.lit(2.0 ** 63) * F.col("__slices"))))
    parts = cut.groupBy(F.col(key).alias("__key"), F.col("__slice").alias("__part")).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = (Window.partitionBy(key, "__slice").orderBy(hashed, "__value")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (cut.join(parts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__part")))
            .withColumn(into, F.col("__before") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
            .drop("__key", "__part", "__before", "__slice", "__slices", "__value"))


def dense_rank_mod(keys: DataFrame, key: str, scratch: Scratch, label: str, into: str = "rank") -> DataFrame:
    """Adds the place (from 0) of each row in ascending order of the distinct ``key``, NULL last.

    Rows are range-partitioned and numbered inside each range; the ranges' sizes, one row per partition, give
    the offsets. No task sees the whole table.
    """
    order = F.col(key).asc_nulls_last()
    ranged = scratch.save(keys.repartitionByRange(max(2, keys.sparkSession.sparkContext.defaultParallelism), order)
                          .withColumn("__range", F.spark_partition_id()), label)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(order)
    return (ranged.join(F.broadcast(sizes), "__range")
            .withColumn(into, F.col("__offset") + F.row_number().over(inside) - 1)
            .drop("__range", "__offset"))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node on an edge ``(a, b)``; the root is the component's smallest node.

    Alternating large-star and small-star rounds: each node hangs its neighbours on the smallest one it knows,
    so paths shorten geometrically and a round never makes more edges than it got. Minima are combined
    before the shuffle; a node with very many neighbours is one hot join key with a single partner row, which
    adaptive execution splits. Each round is a table, so lineage stays one round long.
    """
    current = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                           .distinct(), "edges-0")
    mark = None
    for step in range(1, max_rounds + 1):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a")
                 .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("m").alias("b"))
                 .where("a <> b").distinct())
        current = scratch.save(small, f"edges-{step}")
        got = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{step - 1}")
        if tuple(got) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(got)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def key_groups(batches, keys: list[str]):
    """Groups of consecutive rows with equal keys from Arrow batches that are sorted by them, as pandas frames."""
    import pandas as pd

    held = None
    for batch in batches:
        frame = batch.to_pandas()
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if frame.empty:
            continue
        values = frame[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        for start, end in zip(starts[:-1], starts[1:]):
            yield frame.iloc[start:end]
        held = frame.iloc[starts[-1]:]
    if held is not None and len(held):
        yield held
