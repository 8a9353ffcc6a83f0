"""What both vector searches share: valid rows, copies, query keys and the final ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tools import Scratch


def valid_rows(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Distinct ``(vec_id, vec)`` with an id and finite components only; vec is array<double>."""
    x = F.col(vec).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad)
            .select(F.col("vec_id").cast("long"), x.alias("vec")))


def matrices(batch: pa.RecordBatch, column: int):
    """(row numbers, matrix) per vector length in a batch whose column holds lists of doubles."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = offsets[1:] - offsets[:-1]
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[offsets[:-1][rows][:, None] + np.arange(dim)[None, :]]


def keyed(rows: DataFrame, transform) -> DataFrame:
    """``(vec_id, dim, vec, norm)``: each vector as the bytes of ``transform(matrix)``; rows mapped to None are left out."""
    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, matrix in matrices(batch, 1):
                got, keep = transform(matrix)
                got, at = got[keep], at[keep]
                norm = np.sqrt((got.astype(np.float64) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(np.full(len(at), got.shape[1], dtype=np.int32)),
                     pa.array([row.tobytes() for row in got], pa.binary()), pa.array(norm)],
                    names=["vec_id", "dim", "vec", "norm"])

    return rows.mapInArrow(scan, "vec_id long, dim int, vec binary, norm double")


def copies_limited(rows: DataFrame, k: int) -> DataFrame:
    """At most the k+1 smallest ids of each distinct vector.

    Equal vectors tie in every ranking, so no others can be among a query's best k. The limit is applied in each
    map task before the shuffle too (a group-limited window), so copies of one vector stay few rows.
    """
    number = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    return rows.dropDuplicates(["vec_id", "vec"]).withColumn("__n", number).where(F.col("__n") <= k + 1).drop("__n")


def query_keys(queries: DataFrame, per_block: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Distinct query vectors as ``(vec, dim, qblock, qid)`` in blocks of about ``per_block``, and the block count."""
    distinct = scratch.save(queries.select("vec", "dim").distinct(), "queries")
    blocks = max(1, -(-distinct.count() // per_block))
    block = F.pmod(F.xxhash64("vec"), F.lit(blocks))

    def number(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec", "ascending")])
        first = group.column("qblock")[0].as_py() << 32
        return group.append_column("qid", pa.array(np.arange(len(group), dtype=np.int64) + first))

    return scratch.save(distinct.withColumn("qblock", block).groupBy("qblock").applyInArrow(
        number, "vec binary, dim int, qblock long, qid long"), "numbered"), blocks


class Best:
    """The best k+1 (score, id) of each of b queries: higher scores first, smaller ids among equals."""

    def __init__(self, b: int, k: int, dtype):
        self.k = k + 1
        self.low = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self.scores = np.full((b, self.k), self.low, dtype=dtype)
        self.ids = np.full((b, self.k), np.iinfo(np.int64).max, dtype=np.int64)

    def bar(self) -> np.ndarray:
        """A score that a new row must reach to enter; the lowest value while there are fewer than k+1."""
        return self.scores[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(query):
            return
        which = np.unique(query)
        q = np.concatenate([np.repeat(which, self.k), query])
        s = np.concatenate([self.scores[which].ravel(), score])
        i = np.concatenate([self.ids[which].ravel(), ident])
        order = np.lexsort((i, -s if self.scores.dtype.kind == "f" else ~s, q))
        q, s, i = q[order], s[order], i[order]
        start = np.searchsorted(q, which)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        keep = rank < self.k
        self.scores[q[keep], rank[keep]] = s[keep]
        self.ids[q[keep], rank[keep]] = i[keep]

    def rows(self, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return qids[q], self.ids[q, c], self.scores[q, c]


def ranked(partial: DataFrame, queries: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from partial best lists ``(qid, vec_id, score)`` of distinct queries."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    best = (partial.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("qid")
            .agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best")))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vec").distinct()
    own = asked.join(numbered.select("vec", "qid"), "vec").join(best, "qid")
    others = F.slice(F.filter("best", lambda b: b.vec_id != F.col("query_id")), 1, k)
    return (own.select("query_id", F.posexplode(others).alias("rank", "b"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score"))
