"""SimHash near-duplicate groups, with pivot distance tables to discard pairs.

Equal texts share a fingerprint, so all work after the fingerprints is on distinct ones. Two fingerprints at
``radius`` or fewer differing bits agree on at least two of five bit blocks (radius 3), so each fingerprint goes
to ten buckets, one per pair of blocks (about 26 equal bits), and every pair to be linked meets in one of them.
Inside a bucket each fingerprint has a row of Hamming distances to reference fingerprints (pivots); the triangle
inequality discards every pair whose largest coordinate difference is over the radius, and only the survivors'
fingerprints are compared. A bucket returns a spanning forest of its links, never its pairs, so large groups
cost rows, not squares of rows. Buckets above ``slice_rows`` are cut into slices that meet two by two.

Defined cases: a NULL or empty text, or one without words, has fingerprint zero and links like any other;
repeated rows and repeated ids each return a row; a NULL id takes part and never becomes a component's id
unless nothing else is in it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import Scratch, connected_components, key_groups, local_roots

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 5
PIVOTS = 24
SLICE_ROWS = 2048


def text_fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; ``data`` is UTF-8."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65536):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:at + 65536], ends[at:at + 65536])],
                          dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, fp)`` of every row; fp is the fingerprint's bits as a signed long."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id") if key == "doc_id" else key, F.col("text").cast("binary"))

    def scan(batches):
        for batch in batches:
            values = [text_fingerprint(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=[key, "fp"])

    return slim.mapInArrow(scan, f"{key} {slim.schema[0].dataType.simpleString()}, fp long")


def bucket_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One key per choice of the blocks that a pair within the radius must share."""
    widths = [64 // blocks + (1 if i < 64 % blocks else 0) for i in range(blocks)]
    at = np.cumsum([0, *widths])
    parts = [F.shiftrightunsigned(fp, int(at[i])).bitwiseAND(F.lit((1 << widths[i]) - 1)) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def reference_fingerprints(count: int = PIVOTS) -> np.ndarray:
    """Fixed pivots: half of them cover bit ranges, so that their distances differ where blocks differ."""
    whole = (1 << 64) - 1
    spread = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(count - count // 2)]
    ranges = [(whole // ((1 << (i + 1)) + 1)) & whole for i in range(count // 2)]
    return np.array([*spread, *ranges], dtype=np.uint64)


def near_pairs(fps: np.ndarray, pivots: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within the radius. Pivot coordinates discard, fingerprints decide."""
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    sorted_first, found_i, found_j = table[order, 0], [], []
    reach = np.searchsorted(sorted_first, sorted_first + radius, side="right")
    step = 512
    for at in range(0, len(fps), step):
        rows = np.arange(at, min(at + step, len(fps)))
        counts = reach[rows] - rows - 1
        total = int(counts.sum())
        if not total:
            continue
        i = np.repeat(rows, counts)
        j = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        i, j = order[i], order[j]
        for c in range(1, table.shape[1]):
            keep = np.abs(table[i, c] - table[j, c]) <= radius
            if not keep.all():
                i, j = i[keep], j[keep]
            if not len(i):
                break
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        found_i.append(np.minimum(i[keep], j[keep]))
        found_j.append(np.maximum(i[keep], j[keep]))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(a, b)`` links that connect the same fingerprints as all pairs within the radius do."""
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / slice_rows))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    met = (met.withColumn("own", own)
           .select("fp", "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
           .select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    pivots = reference_fingerprints()

    def link(batches):
        for group in key_groups(batches, ["key", "i", "j"]):
            fps = np.unique(group["fp"].to_numpy().view(np.uint64))
            left, right = near_pairs(fps, pivots, radius)
            if not len(left):
                continue
            root = local_roots(len(fps), left, right)
            child = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[child].view(np.int64)), pa.array(fps[root[child]].view(np.int64))], names=["a", "b"])

    return (met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(link, "a long, b long").distinct())


def _roots(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``distinct`` (one row per ``fp``) with the ``root`` fingerprint of its component."""
    roots = connected_components(fingerprint_links(distinct, radius), scratch)
    return distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    rooted = _roots(distinct, radius, scratch)
    groups = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id (rows without one come last).

    Components are of texts, not ids: rows that share an id but not a component each count. Of rows with the same id and
    fingerprint the one with the least hash of its columns stays, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("h"))
    prints = scratch.save(fingerprints(docs.select("text", row.alias("__row")), "__row"), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("__row").alias("least")), "distinct")
    chosen = scratch.save(_roots(distinct, radius, scratch).groupBy("root").agg(F.min("least").alias("best"))
                          .select(F.col("best.id").alias("__id"), F.col("best.h").alias("__best")), "chosen")
    scratch.drop("prints", "distinct")
    hashed = docs.withColumn("__h", row["h"])
    # equal rows have equal hashes and lie in one component, so one of them is as good as another
    kept = hashed.join(chosen, (F.col("__h") == F.col("__best")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return kept.dropDuplicates(["__h"]).select(*[f"`{c}`" for c in docs.columns])
