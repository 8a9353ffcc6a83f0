"""Approximate nearest neighbours by largest inner product: inverted lists and adaptive dimension scans.

Lists are the cells of k-means centroids, fitted on a bounded sample (about ``SAMPLE`` distinct vectors chosen by
hash); every row is indexed. A query probes the lists whose centroids promise the largest products,
as many as the sample needs to find ``RECALL`` of the true neighbours among its own rows. Inside a list,
vectors are rotated by a fixed random rotation and held in blocks of columns. After each block a candidate is abandoned
for either of two reasons. The seen part and the product of the unseen lengths together miss the query's bar: then it
cannot reach it. Or the difference of the two vectors, both brought to length one, is too long in the seen columns: at
the bar its length is known, and the rotation, which knows nothing of the data, spreads it over the columns by a beta
law, so that this test holds for vectors of any kind. What remains is multiplied out on the original vectors, in doubles.

Lists longer than ``PART_ROWS`` are cut into parts by hash. A streamed task takes a stripe of list parts and a slice
of ``TASK_BLOCKS`` query blocks, one part at a time; its queries' best so far are bars for the parts that follow, and it
returns at most k+1 rows a query. So a crowded list is many tasks and no task holds all queries. Copies of a vector beyond the k+1 smallest ids are dropped first and queries are solved once per
distinct vector. A query's first bar comes from the bounded sample (a true lower bound of its k-th score).

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows without an id
take no part; vectors meet only those of the most frequent length; repeated rows count once; fewer candidates than
k give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import Scratch
from .vectors import Best, copies_limited, keyed, query_keys, ranked, valid_rows

K = 20
SAMPLE = 16_384
BAR_SAMPLE = 2_048
LIST_ROWS = 800
MAX_LISTS = 1_024
#: Share of the sample's own nearest neighbours that the probed lists must hold.
RECALL = 0.975
TEST_QUERIES = 512
PART_ROWS = 8_192
COLUMN_BLOCK = 16
#: Deviations at which a candidate is abandoned: less than one in a thousand true ones is lost per test.
DEVIATIONS = 4.0
#: Below this share of candidates left, they are followed one by one instead of in whole column blocks.
SPARSE = 0.02
QUERY_BLOCK = 2_048
#: Query blocks that meet a list part in one task; more queries are more tasks.
TASK_BLOCKS = 16


def nonzero(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return matrix.astype("<f8"), (matrix != 0).any(axis=1)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means, begun at evenly spaced sample rows."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, centres)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1)[None, :] - 2 * rows @ centres.T, axis=1)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def list_order(queries: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Lists by what they promise each query: the centroid's product and a share of the list's radius."""
    promise = queries @ centres.T + 0.25 * np.linalg.norm(queries, axis=1)[:, None] * spread[None, :]
    return np.argsort(-promise, axis=1, kind="stable")


def probes_for(sample: np.ndarray, centres: np.ndarray, spread: np.ndarray, own: np.ndarray, k: int,
               recall: float) -> int:
    """The least number of lists that hold this share of the best k among the sample, over some of its rows."""
    ask = np.linspace(0, len(sample) - 1, min(TEST_QUERIES, len(sample))).astype(int)
    products = sample[ask] @ sample.T
    products[np.arange(len(ask)), ask] = -np.inf
    best = np.argsort(-products, axis=1)[:, :k]
    order = list_order(sample[ask], centres, spread)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def seen_share(edge: int, dim: int, deviations: float) -> float:
    """The most of a difference's squared length that its first ``edge`` rotated columns hold: the beta law's mean and some deviations."""
    mean = edge / dim
    return mean + deviations * np.sqrt(mean * (1 - mean) / (dim / 2 + 1))


def scan_part(queries: np.ndarray, bars: np.ndarray, vecs: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int,
              deviations: float = DEVIATIONS, width: int = COLUMN_BLOCK) -> Best:
    """The best k+1 of one list part for its queries."""
    dim = vecs.shape[1]
    best = Best(len(queries), k, np.float64)
    q, x = queries @ turn, vecs @ turn
    q_left = np.sqrt(np.maximum(0, np.cumsum((q ** 2)[:, ::-1], axis=1)[:, ::-1]))
    x_left = np.sqrt(np.maximum(0, np.cumsum((x ** 2)[:, ::-1], axis=1)[:, ::-1]))
    edges = [*range(min(width, dim), dim, width), dim]
    # half the share of the squared length that was seen; a zero vector has none
    q_seen, x_seen = ((1 - (left / np.maximum(left[:, :1], 1e-300)) ** 2) / 2 for left in (q_left, x_left))
    for at in range(0, len(vecs), 1024):
        rows = slice(at, at + 1024)
        bar = np.maximum(bars, best.bar())
        live, done, part, i, j = np.flatnonzero(np.isfinite(bar)), 0, 0.0, None, None
        open_ = np.flatnonzero(~np.isfinite(bar))
        if len(open_):  # no bar yet: the best of this block set it
            whole = queries[open_] @ vecs[rows].T
            if whole.shape[1] > best.k:
                a, b = np.nonzero(whole >= np.partition(whole, -best.k, axis=1)[:, -best.k, None] - 1e-9)
            else:
                a, b = (v.ravel() for v in np.indices(whole.shape))
            a, b = open_[a], b + at
            best.add(a, np.einsum("ij,ij->i", queries[a], vecs[b]), ids[b])
        if not len(live):
            continue
        for edge in edges:
            share = seen_share(edge, dim, deviations) if edge < dim else 1.0
            if i is None:  # many candidates are left: whole column blocks
                part = part + q[live, done:edge] @ x[rows, done:edge].T
                limit = (bar[live] - 1e-9 * (1 + np.abs(bar[live])))[:, None]
                alive = part >= limit
                if edge < dim:
                    alive = part + q_left[live, edge, None] * x_left[None, rows, edge] >= limit
                    if share < 1:
                        spare = share - q_seen[live, edge, None] - x_seen[None, rows, edge]
                        alive &= part + q_left[live, 0, None] * x_left[None, rows, 0] * spare >= share * limit
                some = alive.any(axis=1)
                live, part, alive = live[some], part[some], alive[some]
                if edge == dim or np.count_nonzero(alive) < SPARSE * alive.size:
                    i, j = np.nonzero(alive)
                    part, i, j = part[i, j], live[i], j + at
            else:
                part = part + np.einsum("ij,ij->i", q[i, done:edge], x[j, done:edge])
                least = bar[i] - 1e-9 * (1 + np.abs(bar[i]))
                if edge == dim:
                    keep = part >= least
                else:
                    keep = part + q_left[i, edge] * x_left[j, edge] >= least
                    if share < 1:
                        spare = share - q_seen[i, edge] - x_seen[j, edge]
                        keep &= part + q_left[i, 0] * x_left[j, 0] * spare >= share * least
                i, j, part = i[keep], j[keep], part[keep]
            done = edge
            if not len(live) or (i is not None and not len(i)):
                break
        if i is None:
            continue
        if len(i):
            best.add(i, np.einsum("ij,ij->i", queries[i], vecs[j]), ids[j])
    return best


class Kept:
    """The best found so far of the queries that one task has met."""

    def __init__(self, k: int):
        self.k, self.row, self.best = k, {}, Best(1024, k, np.float64)

    def rows_of(self, qids: np.ndarray) -> np.ndarray:
        rows = np.array([self.row.setdefault(q, len(self.row)) for q in qids.tolist()], dtype=np.int64)
        if len(self.row) > len(self.best.ids):
            more = Best(2 * len(self.row) - len(self.best.ids), self.k, np.float64)
            self.best.scores = np.concatenate([self.best.scores, more.scores])
            self.best.ids = np.concatenate([self.best.ids, more.ids])
        return rows

    def batch(self) -> pa.RecordBatch:
        at, ids, scores = self.best.rows(np.arange(len(self.best.ids)))
        qids = np.fromiter(self.row, dtype=np.int64, count=len(self.row))[at]
        return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids), pa.array(scores)], names=["qid", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, query_block: int = QUERY_BLOCK,
           task_blocks: int = TASK_BLOCKS, stripes: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query, itself left out."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(keyed(valid_rows(vectors), nonzero), "rows")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    rows = rows.where(F.col("dim") == dim)
    asked = rows.where(is_query)
    candidates = scratch.save(copies_limited(rows, k), "candidates")
    n = candidates.count()
    rate = min(1.0, SAMPLE / max(n, 1))
    drawn = candidates.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1))
    drawn = drawn.select("vec_id", "vec").orderBy(F.xxhash64("vec"), "vec_id").limit(2 * SAMPLE).collect()
    sample = np.frombuffer(b"".join(r["vec"] for r in drawn), dtype="<f8").reshape(-1, dim) if drawn else np.ones((1, dim))
    few_ids = np.array([r["vec_id"] for r in drawn[:BAR_SAMPLE]], dtype=np.int64)
    lists = int(min(MAX_LISTS, max(1, n // LIST_ROWS), len(sample)))
    centres = centroids_of(sample, lists)
    own = nearest(sample, centres)
    spread = np.zeros(lists)
    np.maximum.at(spread, own, np.linalg.norm(sample - centres[own], axis=1))
    probes = probes_for(sample, centres, spread, own, k, recall)
    few = sample[:len(few_ids)]  # one more list, which every query probes first: it sets the bars
    model = spark.sparkContext.broadcast((centres, spread, few, rotation(dim)))

    def assign(batches):
        c = model.value[0]
        for batch in batches:
            blob = batch.column(1).to_pylist()
            own = nearest(np.frombuffer(b"".join(blob), dtype="<f8").reshape(-1, dim), c) if blob else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["vec_id", "vec", "list"])

    listed = scratch.save(candidates.select("vec_id", "vec").mapInArrow(assign, "vec_id long, vec binary, list long"), "listed")
    counts = np.zeros(lists, dtype=np.int64)
    for r in listed.groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    parts = np.maximum(1, -(-counts // PART_ROWS))
    part_of = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), (F.col("list") + 1).cast("int"))
    members = listed.withColumn("part", F.pmod(F.xxhash64("vec_id"), part_of.cast("long")))
    numbered, n_blocks = query_keys(asked, query_block, scratch)
    slices = -(-n_blocks // task_blocks)  # a list part and this share of the queries are one task
    members = members.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def probe(batches):
        c, r, some, _ = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, dim)
            chosen = list_order(q, c, r)[:, :probes]
            bars = scan_part(q, np.full(len(q), -np.inf), some, few_ids, model.value[3], k).bar()
            at, which = np.repeat(np.arange(len(q)), probes), chosen.ravel()
            times = parts[which]
            at, which = np.repeat(at, times), np.repeat(which, times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which.astype(np.int64)), pa.array(part.astype(np.int64)), batch.column(0).take(take),
                 batch.column(1).take(take), batch.column(2).take(take), pa.array(bars[at])],
                names=["list", "part", "qid", "vec", "slice", "bar"])

    probing = numbered.select("qid", "vec", F.pmod("qblock", F.lit(slices)).cast("long").alias("slice")).mapInArrow(
        probe, "list long, part long, qid long, vec binary, slice long, bar double")

    def scan(batches):
        kept, task, place, held = None, None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if start == end:
                    continue
                *here, is_query = keys[start].tolist()
                some = batch.slice(start, end - start)
                if here[:2] != task:
                    if kept is not None:
                        yield kept.batch()
                    kept, task = Kept(k), here[:2]
                if here != place:
                    place, held = here, []
                vecs = np.frombuffer(b"".join(some.column("vec").to_pylist()), dtype="<f8").reshape(-1, dim)
                idents = some.column("ident").to_numpy()
                if not is_query:
                    held.append((vecs, idents))
                elif held:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                    for at in range(0, len(vecs), QUERY_BLOCK):
                        few_q = slice(at, at + QUERY_BLOCK)
                        rows = kept.rows_of(idents[few_q])
                        bars = np.maximum(some.column("bar").to_numpy()[few_q], kept.best.bar()[rows])
                        best = scan_part(vecs[few_q], bars, *held[0], model.value[3], k)
                        found, ids, scores = best.rows(rows)
                        kept.best.add(found, scores, ids)
        if kept is not None:
            yield kept.batch()

    def first(batches):
        for batch in batches:
            if batch.num_rows and len(few_ids):
                q = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, dim)
                best = scan_part(q, np.full(len(q), -np.inf), model.value[2], few_ids, model.value[3], k)
                qid, vec_id, score = best.rows(batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vec_id), pa.array(score)],
                                                 names=["qid", "vec_id", "score"])

    begun = numbered.select("qid", "vec").mapInArrow(first, "qid long, vec_id long, score double")
    # each task goes through its stripe of list parts with its queries' best so far as bars
    names = ["stripe", "slice", "list", "part", "kind", "ident", "vec", "bar"]
    stripe = F.pmod(F.col("list") + F.col("part"), F.lit(stripes or max(2, spark.sparkContext.defaultParallelism))).cast("long")
    both = (members.withColumns({"kind": F.lit(0).cast("long"), "bar": F.lit(0.0), "stripe": stripe})
            .withColumnRenamed("vec_id", "ident").select(names)
            .union(probing.withColumns({"kind": F.lit(1).cast("long"), "stripe": stripe})
                   .withColumnRenamed("qid", "ident").select(names)))
    partial = (both.repartition("stripe", "slice").sortWithinPartitions("stripe", "slice", "list", "part", "kind")
               .mapInArrow(scan, "qid long, vec_id long, score double"))
    return ranked(partial.union(begun).dropDuplicates(["qid", "vec_id"]), asked, numbered, k)


def nearest_twenty(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0, K)
