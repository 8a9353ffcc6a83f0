"""Packing by lexical retrieval: every window is filled with the unused documents most like its first one.

Terms are token ids, so document frequencies are a table of one row per vocabulary entry at any corpus size; they
and the mean length are counted over all documents. Documents are sharded by the term that weighs most in them
(tf x idf) and, inside a term, by hash: a shard is a range of about ``shard_docs`` ranks, so a term shared by a
third of all documents makes many shards and rare terms share one. Each shard holds a BM25 inverted index of its
documents. Seeds are taken in rank order; the index returns the seed's unused neighbours, best first, and these
fill the window; the document cut at its end opens the next window. So every window of a shard is full but the
last, which is cut into powers of two and needs no padding either.

Defined cases: a NULL or empty text is the end id alone; repeated rows and NULL ids are documents of their own;
extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, vocabulary_path
from .tools import Scratch, with_fields

CAPACITY = 2048
SHARD_DOCS = 256
K1, B = 1.2, 0.75
JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_table(docs: DataFrame, scratch: Scratch, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n, h, ids, terms, tfs`` (binary), and per task a row ``stats`` with its counts."""
    json_path, rank_path = json_path or vocabulary_path(JSON), rank_path or vocabulary_path(RANKS)

    def scan(batches):
        enc = encoder(json_path, rank_path)
        frequency, seen, tokens = np.zeros(enc.size, dtype=np.int64), 0, 0
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = enc.ids(text)
                terms, tfs = np.unique(ids, return_counts=True)
                frequency[terms] += 1
                seen, tokens = seen + 1, tokens + len(ids)
                rows.append((len(ids), ids_crc32(ids), ids.tobytes(), terms.tobytes(), tfs.astype("<u4").tobytes()))
            if rows:
                n, h, ids, terms, tfs = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(terms, pa.binary()), pa.array(tfs, pa.binary()), pa.nulls(len(n), pa.binary())],
                    names=["doc_id", "n", "h", "ids", "terms", "tfs", "stats"])
        if seen:
            some = np.flatnonzero(frequency)
            packed = np.concatenate([[seen, tokens, len(some)], some, frequency[some]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()),
                 *[pa.nulls(1, pa.binary())] * 3, pa.array([packed], pa.binary())],
                names=["doc_id", "n", "h", "ids", "terms", "tfs", "stats"])

    return scratch.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, n long, h long, ids binary, terms binary, tfs binary, stats binary"), "tokens")


def corpus_statistics(table: DataFrame, vocabulary: int) -> tuple[int, float, np.ndarray]:
    """Documents, mean length and document frequencies, summed by Spark; at most one row per vocabulary entry."""
    def split(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                v = np.frombuffer(blob, dtype="<i8")
                k = int(v[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([[-2, -1], v[3:3 + k]])), pa.array(np.concatenate([v[:2], v[3 + k:]]))],
                    names=["term", "n"])

    rows = (table.where("stats is not null").select("stats").mapInArrow(split, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    counts = {r["term"]: r["n"] for r in rows}
    frequency = np.zeros(vocabulary, dtype=np.float64)
    for term, n in counts.items():
        if term >= 0:
            frequency[term] = n
    docs = counts.get(-2, 0)
    return docs, counts.get(-1, 0) / max(docs, 1), frequency


def fill_windows(lengths: np.ndarray, neighbours, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; documents are seeds in their order.

    ``neighbours(seed)`` lists all documents, most alike first.
    """
    pieces, free, after, carry, sequence = [], np.ones(len(lengths), dtype=bool), 0, None, 0
    tail: list[tuple[int, int, int]] = []
    while True:
        if carry is not None:
            seed, start = carry
            carry = None
        else:
            while after < len(lengths) and not free[after]:
                after += 1
            if after == len(lengths):
                break
            seed, start = after, 0
            free[seed] = False
        left = int(lengths[seed]) - start
        while left >= capacity:
            pieces.append((seed, start, capacity, sequence, 0))
            sequence, start, left = sequence + 1, start + capacity, left - capacity
        if not left:
            continue
        window, filled = [(seed, start, left)], left
        order = neighbours(seed)
        for other in order[free[order]].tolist():
            take = min(int(lengths[other]), capacity - filled)
            window.append((other, 0, take))
            free[other] = False
            filled += take
            if take < lengths[other]:
                carry = (other, take)
            if filled == capacity:
                break
        if filled < capacity:
            tail = window
            break
        at = 0
        for doc, begin, length in window:
            pieces.append((doc, begin, length, sequence, at))
            at += length
        sequence += 1
    rest = sum(length for _, _, length in tail)
    room = at = 0
    for doc, begin, length in tail:  # powers of two, largest first
        while length:
            if not room:
                room, at = 1 << (rest.bit_length() - 1), 0
            take = min(length, room)
            pieces.append((doc, begin, take, sequence, at))
            begin, length, room, at, rest = begin + take, length - take, room - take, at + take, rest - take
            if not room:
                sequence += 1
    return pieces


class Index:
    """BM25 inverted index of one shard: postings by term with their weights."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, lengths: np.ndarray,
                 mean: float, k1: float = K1, b: float = B):
        self.n = len(terms)
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        doc = np.repeat(np.arange(self.n), sizes)
        term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.float32)
        order = np.argsort(term, kind="stable")
        norm = k1 * (1 - b + b * lengths / max(mean, 1e-9))
        weight = idf[term] * tf * (k1 + 1) / (tf + norm[doc])
        self.docs, self.weights, self.queries = doc[order], weight[order], terms
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        query = self.queries[seed]
        start = self.starts[query]
        size = self.starts[query.astype(np.int64) + 1] - start
        at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        scores = np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)
        return np.argsort(-scores, kind="stable")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, with_ids: bool = True,
         json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """The pieces of all documents; ``ids`` are the piece's ids (unsigned little-endian) if asked for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    table = token_table(docs, scratch, json_path, rank_path)
    enc = encoder(json_path or vocabulary_path(JSON), rank_path or vocabulary_path(RANKS))
    dtype = enc.dtype
    n_docs, mean, frequency = corpus_statistics(table, enc.size)
    idf = np.log(1 + (n_docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    rows = table.where("stats is null").drop("stats")
    shared_idf = spark.sparkContext.broadcast(idf)

    def main_term(terms: bytes, tfs: bytes) -> int:
        t = np.frombuffer(terms, dtype=dtype)
        return int(t[np.argmax(np.frombuffer(tfs, dtype="<u4") * shared_idf.value[t])])

    def count(batches):
        total = np.zeros(enc_size, dtype=np.int64)
        for batch in batches:
            for terms, tfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[main_term(terms, tfs)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    enc_size = enc.size
    per_term = np.zeros(enc_size, dtype=np.int64)
    for r in rows.select("terms", "tfs").mapInArrow(count, "term long, n long").groupBy("term").agg(
            F.sum("n").alias("n")).collect():
        per_term[r["term"]] = r["n"]
    ranks = spark.sparkContext.broadcast((np.cumsum(per_term) - per_term, per_term))

    def shard(batches):
        before, size = ranks.value
        for batch in batches:
            main = np.array([main_term(t, f) for t, f in zip(
                batch.column("terms").to_pylist(), batch.column("tfs").to_pylist())], dtype=np.int64)
            unit = batch.column("u").to_numpy() / 2.0 ** 63
            rank = before[main] + np.minimum((unit * size[main]).astype(np.int64), size[main] - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank // shard_docs), pa.array(rank)],
                                             names=[*batch.schema.names, "shard", "rank"])

    keyed = rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 1))
    sharded = keyed.mapInArrow(shard, with_fields(keyed, shard="long", rank="long"))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("u", "ascending"), ("doc_id", "ascending")])
        ids = [np.frombuffer(x, dtype=dtype) for x in group.column("ids").to_pylist()]
        lengths = group.column("n").to_numpy()
        index = Index([np.frombuffer(x, dtype=dtype) for x in group.column("terms").to_pylist()],
                      [np.frombuffer(x, dtype="<u4") for x in group.column("tfs").to_pylist()],
                      shared_idf.value, lengths, mean)
        pieces = fill_windows(lengths, index.neighbours, capacity)
        doc, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces))
        cut = [ids[d][s:s + k] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
        first = group.column("shard")[0].as_py() << 32
        return pa.table({
            "doc_id": group.column("doc_id").combine_chunks().take(pa.array(doc)), "start": start, "length": length,
            "ids_crc32": pa.array([ids_crc32(x) for x in cut], pa.int64()), "doc_tokens": lengths[doc],
            "sequence_id": sequence + first, "offset": offset,
            "ids": pa.array([x.tobytes() for x in cut] if with_ids else [None] * len(cut), pa.binary())})

    return sharded.drop("h").groupBy("shard").applyInArrow(fill, PIECES)


def pack_report(docs: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs, with_ids=False).drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window, its pieces in order: at most ``capacity`` tokens each."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(
        F.struct("offset", "doc_id", "start", "length", "ids"))).alias("pieces"))
