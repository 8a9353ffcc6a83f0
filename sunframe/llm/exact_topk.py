"""Exact top-k inner products of integer vectors.

Vectors are processed in blocks of descending length. A block whose longest vector cannot reach a query's bar (its
current k-th score) by Cauchy-Schwarz is skipped for the query. Inside a block, rotated vectors (the axes are those
of the table's singular value decomposition, strongest first) give partial sums over the leading dimensions; adding
the product of the residual lengths bounds the whole product, and only pairs whose bound reaches the bar are
multiplied out, in integers.

Every (query block, stripe of vector blocks) is one streamed task: it holds the queries and one vector block at a
time. Stripes are dealt round the length order, so each begins with long vectors and sets its bars early. Copies
of a vector beyond the k+1 smallest ids cannot be among the best and are dropped first; queries are solved once per
distinct vector. So a vector that a third of all rows share makes no hot task.

Defined cases: vectors that are NULL, empty, or hold NULL or non-finite components, and rows without an id take no
part; vectors meet only those of their own length; repeated rows count once; fewer candidates than k give fewer
rows; extra columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import Scratch
from .vectors import Best, copies_limited, keyed, query_keys, ranked, valid_rows

K = 20
SCALE = 64
QUERY_BLOCK = 2048
VECTOR_BLOCK = 1024
#: Shares of the dimensions after which partial sums are bounded.
HEADS = (0.125, 0.25, 0.5, 0.75, 1.0)
#: Below this share of pairs left, pairs are followed one by one instead of in whole matrices.
SPARSE = 0.02


def to_integers(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scaled = np.floor(SCALE * matrix)
    return scaled.astype("<i8"), np.ones(len(matrix), dtype=bool)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the right singular vectors, strongest first; Spark sums the products of the components."""
    def scan(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            blobs = batch.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                m = np.frombuffer(b"".join([blobs[i] for i in np.flatnonzero(dims == dim)]), dtype="<i8")
                m = m.reshape(-1, dim).astype(np.float64)
                sums[dim] = sums.get(dim, 0) + m.T @ m
        for dim, gram in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim * dim, dim, dtype=np.int32)), pa.array(np.arange(dim * dim)), pa.array(gram.ravel())],
                names=["dim", "cell", "x"])

    cells = (rows.select("dim", "vec").mapInArrow(scan, "dim int, cell long, x double")
             .groupBy("dim", "cell").agg(F.sum("x").alias("x")).toPandas())
    out = {}
    for dim, part in cells.groupby("dim"):
        gram = np.zeros(dim * dim)
        gram[part["cell"].to_numpy()] = part["x"].to_numpy()
        gram = gram.reshape(dim, dim)
        out[int(dim)] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()
    return out


class Queries:
    """One block of distinct queries and their best lists."""

    def __init__(self, vecs: np.ndarray, qids: np.ndarray, axes: np.ndarray, k: int):
        self.whole, self.qids, self.axes = vecs, qids, axes
        self.rotated = vecs.astype(np.float64) @ axes
        self.norms = np.sqrt((self.rotated ** 2).sum(axis=1))
        self.best = Best(len(vecs), k, np.int64)
        self.sums = np.cumsum(self.rotated ** 2, axis=1)

    def done_squares(self, h: int) -> np.ndarray:
        return self.sums[:, h - 1]

    def products(self, q: np.ndarray, x: np.ndarray, vecs: np.ndarray, limit: float) -> np.ndarray:
        """Integer products of all (whole blocks) or of paired rows."""
        if limit < 2.0 ** 52:  # exact in doubles
            a, b = self.whole[q].astype(np.float64), vecs[x].astype(np.float64)
        else:
            a, b = self.whole[q], vecs[x]
        return np.einsum("ij,ij->i", a, b).astype(np.int64)

    def meet(self, vecs: np.ndarray, ids: np.ndarray) -> None:
        rotated = vecs.astype(np.float64) @ self.axes
        squares = rotated ** 2
        norms = np.sqrt(squares.sum(axis=1))
        bar = self.best.bar().astype(np.float64)
        longest = norms.max()
        slack = 1e-6 * (1.0 + self.norms * longest)
        live = np.flatnonzero(self.norms * longest + slack >= bar)
        limit = float(self.norms.max() * longest)
        open_bar = self.best.bar() == self.best.low
        if not len(live):
            return
        if open_bar[live].any():  # no bars yet: multiply the block out, keep each query's best
            whole = (self.whole[live].astype(np.float64) @ vecs.T.astype(np.float64)).astype(np.int64) \
                if limit < 2.0 ** 52 else self.whole[live] @ vecs.T
            k = self.best.k
            least = np.partition(whole, whole.shape[1] - k, axis=1)[:, -k] if whole.shape[1] > k else whole.min(axis=1)
            i, j = np.nonzero(whole >= np.maximum(least, self.best.bar()[live])[:, None])
            self.best.add(live[i], whole[i, j], ids[j])
            return
        dim = vecs.shape[1]
        part = np.zeros((len(live), len(vecs)))
        i = j = None
        done = 0
        for h in sorted({max(1, round(dim * share)) for share in HEADS}):
            q_rest = np.sqrt(np.maximum(0.0, self.norms ** 2 - self.done_squares(h)))
            x_rest = np.sqrt(np.maximum(0.0, squares[:, h:].sum(axis=1)))
            if i is None:  # many pairs are left: whole matrices
                part += self.rotated[live, done:h] @ rotated[:, done:h].T
                alive = part + q_rest[live, None] * x_rest[None, :] >= (bar - slack)[live, None]
                some = alive.any(axis=1)
                if not some.all():
                    live, part, alive = live[some], part[some], alive[some]
                if np.count_nonzero(alive) < SPARSE * alive.size or h == dim:
                    i, j = np.nonzero(alive)
                    part, i = part[i, j], live[i]
            else:
                part = part + np.einsum("ij,ij->i", self.rotated[i, done:h], rotated[j, done:h])
                keep = part + q_rest[i] * x_rest[j] + slack[i] >= bar[i]
                i, j, part = i[keep], j[keep], part[keep]
            done = h
            if not len(live) or (i is not None and not len(i)):
                return
        score = self.products(i, j, vecs, limit)
        keep = score >= self.best.bar()[i]
        self.best.add(i[keep], score[keep], ids[j[keep]])


def vector_blocks(rows: DataFrame, stripes: int, block: int = VECTOR_BLOCK) -> DataFrame:
    """Blocks of vectors in descending length: ``dim, stripe, place`` (ascending from the longest), ``ids, vecs``."""
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism)

    def cut(batches):
        held: dict[int, list] = {}
        made = 0

        def emit(dim):
            nonlocal made
            ids, blobs, norms = zip(*held.pop(dim))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([made % stripes], pa.int64()), pa.array([-norms[0]], pa.float64()),
                 pa.array([np.array(ids, dtype="<i8").tobytes()]), pa.array([b"".join(blobs)])],
                names=["dim", "stripe", "place", "ids", "vecs"])

        for batch in batches:
            for ident, dim, blob, norm in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault(dim, []).append((ident, blob, norm))
                if len(held[dim]) == block:
                    yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    order = [F.desc("norm"), F.col("vec_id")]
    return (rows.select("vec_id", "dim", "vec", "norm").repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .mapInArrow(cut, "dim int, stripe long, place double, ids binary, vecs binary"))


def search(vectors: DataFrame, is_query: Column, k: int = K, stripes: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query, itself left out."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    stripes = stripes or max(2, spark.sparkContext.defaultParallelism)
    rows = scratch.save(keyed(valid_rows(vectors), to_integers), "rows")
    asked = rows.where(is_query)
    numbered, n_blocks = query_keys(asked, QUERY_BLOCK, scratch)
    candidates = scratch.save(copies_limited(rows, k), "candidates")
    axes = spark.sparkContext.broadcast(rotations(candidates))

    def block_up(group: pa.Table) -> pa.Table:
        group = group.sort_by([("qid", "ascending")])
        return pa.table({
            "qblock": group.column("qblock")[:1], "dim": group.column("dim")[:1],
            "ids": pa.array([group.column("qid").to_numpy().astype("<i8").tobytes()]),
            "vecs": pa.array([b"".join(group.column("vec").to_pylist())])})

    shape = "qblock long, stripe long, dim int, kind int, place double, ids binary, vecs binary"
    names = [c.split()[0] for c in shape.split(", ")]
    queries = (numbered.groupBy("qblock", "dim").applyInArrow(block_up, "qblock long, dim int, ids binary, vecs binary")
               .withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
               .withColumn("kind", F.lit(0)).withColumn("place", F.lit(0.0)).select(names))
    blocks = (vector_blocks(candidates, stripes)
              .withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
              .withColumn("kind", F.lit(1)).select(names))

    def solve(batches):
        now, key = None, None

        def done():
            q, v, s = now.best.rows(now.qids)
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["qid", "vec_id", "score"])

        for batch in batches:
            for qblock, stripe, dim, kind, _, ids, vecs in zip(*[c.to_pylist() for c in batch.columns]):
                matrix = np.frombuffer(vecs, dtype="<i8").reshape(-1, dim)
                if (qblock, stripe, dim) != key:
                    if now is not None:
                        yield done()
                    key = (qblock, stripe, dim)
                    now = None if kind else Queries(matrix, np.frombuffer(ids, dtype="<i8"), axes.value[dim], k)
                if kind and now is not None:
                    now.meet(matrix, np.frombuffer(ids, dtype="<i8"))
        if now is not None:
            yield done()

    met = (queries.union(blocks).repartition(F.col("qblock"), F.col("stripe"))
           .sortWithinPartitions("qblock", "stripe", "dim", "kind", "place"))
    partial = met.mapInArrow(solve, "qid long, vec_id long, score long")
    return ranked(partial, asked, numbered, k)


def top_twenty(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0, K)
