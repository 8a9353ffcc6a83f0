"""Best-fit-decreasing packing of all documents into fixed windows of token ids.

Documents longer than a window are split without loss: full windows, and a remainder. Pieces are dealt by a hash to
shards of about ``shard_bytes`` of text (a token is at least a byte, so that bounds a shard's ids too), and each shard
packs its own: lengths in descending order, each to the fullest window that still has room, found with a segment tree
over capacities. That looks at lengths only, so it runs on their histogram: windows with the same room are kept as
runs, and pieces of one length are placed as runs. Ids move once, straight to their shard; a shard leaves about one
window partly filled, a small part of its hundreds. Pieces that are the same in everything are told apart by their
count within the task that reads them, so repeated rows make no hot shard and a task that runs anew deals the same.

A window is a row of its ids (``ids``, little-endian unsigned 32-bit, padded), the cumulative segment lengths
``cu_seqlens`` and, per segment, where position ids start anew (``position_resets``).

Defined cases: a NULL or empty text is the end id alone; repeated rows and NULL ids are documents of their own;
extra columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval_packing import JSON, RANKS, ids_crc32
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
PAD = 0
#: Bytes of text per shard, and ids that a task holds before it hands them on.
SHARD_BYTES = 4 << 20
HELD_IDS = 1 << 20
WINDOWS = ("sequence_id long, n_tokens long, n_segments int, doc_ids array<long>, starts array<long>, "
           "cu_seqlens array<int>, position_resets array<int>, ids_crc32 long, ids binary")


class Rooms:
    """A segment tree over capacities: the smallest room of at least some size that any window has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.has = np.zeros(2 * self.size, dtype=bool)

    def put(self, room: int, there: bool) -> None:
        at = room + self.size
        self.has[at] = there
        while at > 1:
            at //= 2
            self.has[at] = self.has[2 * at] or self.has[2 * at + 1]

    def fitting(self, length: int) -> int | None:
        at = length + self.size
        if self.has[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.has[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first window, room before, pieces per window) and the number of windows.

    The pieces of a run fill its windows one after the other, ``pieces per window`` each.
    """
    rooms, runs, opened = Rooms(capacity), [], 0
    waiting: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, window: int, n: int) -> None:
        if n and room:
            waiting.setdefault(room, []).append((window, n))
            rooms.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.fitting(length)
            if room is None:
                room, window, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                window, n = waiting[room].pop(0)
                if not waiting[room]:
                    del waiting[room]
                    rooms.put(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, window, room, each))
                leave(room - each * length, window, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # the last pieces share one window
                runs.append((length, rank, left, window + full, room, each))
                leave(room - left * length, window + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(room, window + full, n - full)
    return runs, opened


def token_pieces(docs: DataFrame, capacity: int, json_path: str, rank_path: str) -> DataFrame:
    """``doc_id, start, length, crc, nth, ids``: full windows and remainders; equal pieces of a task are counted by ``nth``."""
    def record(rows):
        ident, start, length, crc, nth, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ident, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(crc, pa.int64()), pa.array(nth, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "length", "crc", "nth", "ids"])

    def scan(batches):
        enc, met = encoder(json_path, rank_path), Counter()
        rows, held = [], 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text)
                for start in range(0, len(ids), capacity):
                    cut = ids[start:start + capacity]
                    crc = ids_crc32(cut)
                    same = hash((ident, start, crc))
                    rows.append((ident, start, len(cut), crc, met[same], cut.tobytes()))
                    met[same] += 1
                held += len(ids)
                if held > HELD_IDS:
                    yield record(rows)
                    rows, held = [], 0
        if rows:
            yield record(rows)

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(scan, "doc_id long, start long, length long, crc long, nth long, ids binary"))


def pack(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per window; ``sequence_id`` is unique, not gapless."""
    json_path, rank_path = json_path or vocabulary_path(JSON), rank_path or vocabulary_path(RANKS)
    dtype = encoder(json_path, rank_path).dtype
    # a document has at most one id per byte, and its end
    most = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    shards = -(-int(most) // shard_bytes) or 1

    def build(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("crc", "ascending")])
        length = group.column("length").to_numpy()
        # runs come by descending length and rising rank: the order of the sorted pieces
        runs, _ = plan(Counter(length.tolist()), capacity)
        window = np.concatenate([first + np.arange(n) // each for _, _, n, first, _, each in runs])
        offset = np.concatenate([capacity - room + np.arange(n) % each * size for size, _, n, _, room, each in runs])
        order = np.lexsort((offset, window))
        group, length, window = group.take(order), length[order], window[order]
        doc, start, ids = (group.column(c).to_pylist() for c in ("doc_id", "start", "ids"))
        cuts = np.flatnonzero(np.diff(window)) + 1
        shard, rows = key[0].as_py(), []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(window)]):
            flat = np.frombuffer(b"".join(ids[a:b]), dtype=dtype)
            ends = np.cumsum(length[a:b]).tolist()
            whole = np.full(capacity, PAD, dtype="<u4")
            whole[:len(flat)] = flat
            rows.append({"sequence_id": int(window[a]) * shards + shard, "n_tokens": len(flat), "n_segments": b - a,
                         "doc_ids": doc[a:b], "starts": start[a:b], "cu_seqlens": [0, *ends],
                         "position_resets": [0, *ends[:-1]], "ids_crc32": ids_crc32(flat), "ids": whole.tobytes()})
        return pa.Table.from_pylist(rows, schema=SCHEMA)

    return (token_pieces(docs, capacity, json_path, rank_path)
            .withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", "crc", "nth"), F.lit(shards)))
            .drop("nth").groupBy("__shard").applyInArrow(build, WINDOWS))


SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("n_segments", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
                    ("position_resets", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def write_windows(docs: DataFrame, path: str, **options) -> None:
    """The windows as Parquet: one fixed-width binary row of ids per window with its segment columns."""
    pack(docs, **options).write.option("compression", "zstd").parquet(path)
