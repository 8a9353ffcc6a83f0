"""Periodic runs in the words of documents, found tile by tile and stitched by document and period.

A run is a longest stretch of words in which words ``q`` apart are equal, ``q`` being its smallest period, and which
is at least twice ``q`` and 12 words long. Positions ``i`` whose word equals word ``i + q`` form intervals; a run of
period ``q`` is such an interval of at least ``max(q, 12 - q)`` positions, and its last ``q`` words.

Documents are cut into overlapping tiles per octave of periods ``P .. 2P - 1``: the longer the periods, the larger the
tiles, so a tile's work stays linear and a very long document becomes many rows that Spark deals out. Every
interval that counts covers a boundary, a multiple of the octave's step. At a boundary the periods worth a look are
those at which three words on either side recur; their extents to both sides are the Z-values of the text that
begins and of the reversed text that ends there (taken directly for a few periods, by the linear Z-algorithm for many).
Neighbouring tiles overlap by more than the shortest interval that counts, so the fragments of a long run touch:
they are shuffled by document and period and joined into whole intervals. An interval found for several periods
keeps the smallest one. Documents that fit in one tile are solved where they are read, many at once; their intervals are
whole, so nothing of them is shuffled.

Defined cases: a NULL, empty or white text has no words and no run; repeated rows and repeated or NULL ids return a
row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tools import Scratch

#: Fixed: the least words of a run, and how often its period must fit.
LEAST = 12
REPEATS = 2
#: Words of the smallest tile; documents up to this size are one tile.
TILE = 4096
#: A tile of octave P has 16 P words, starts 12 P after the one before and so shares 4 P words with it.
TILE_OCTAVES, STEP_OCTAVES = 16, 12
#: Words that are solved in one go.
BATCH_WORDS = 200_000
#: Periods at one boundary from which on the linear Z-algorithm is the cheaper way.
MANY = 256

RUNS = "array<struct<start:long,length:long,period:long>>"


def least_interval(q):
    """Positions of an interval of period q that make a run."""
    return np.maximum(q, LEAST - q)


def z_values(x: list) -> np.ndarray:
    """For each place of x the length of the common prefix of x and what begins there (linear time)."""
    n, left, right = len(x), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, dtype=np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, looked for in windows that grow."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        same = a[at:end] == b[at:end]
        if not same.all():
            return at + int(same.argmin())
        at, step = end, step * 8
    return n


def boundary_periods(marks: np.ndarray, n: int, octave: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) pairs of an octave at which three words after or before the boundary recur.

    ``marks`` are hashes of three consecutive words, zero where there are none; it reaches 2 P + step beyond n.
    """
    rows = (n + step - 1) // step
    stride = marks.strides[0]

    def recur(shift: int) -> np.ndarray:
        own = marks[shift:][:rows * step:step][:rows, None]
        ahead = np.lib.stride_tricks.as_strided(marks[shift + octave:], shape=(rows, octave), strides=(step * stride, stride))
        return (ahead == own) & (own != 0)

    found = recur(3)  # three words from the boundary on; marks begin with three empty places
    found |= recur(0)  # the three before it
    at, ahead = np.nonzero(found)
    return at * step, ahead + octave


def word_marks(codes: np.ndarray, room: int) -> np.ndarray:
    """Hashes of three consecutive words with three empty places before and ``room`` after them."""
    n = len(codes)
    marks = np.zeros(n + room + 6, dtype=np.uint64)
    if n >= 3:
        c = codes.astype(np.uint64) + np.uint64(1)
        a, b, d = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        marks[3:n + 1] = (c[:-2] * a ^ (c[1:-1] * b + (c[2:] ^ a) * d)) | np.uint64(1)
    return marks


def fragments(codes: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """``(q, s, e)``: intervals [s, e) of equal words q apart, long enough for a run, periods low to high."""
    n, out = len(codes), []
    octave = low
    marks = word_marks(codes, 4 * max(high, 6))
    while octave <= high:
        step = max(octave, LEAST // 2)
        bounds, periods = boundary_periods(marks, n, octave, step)
        fit = (periods <= high) & (bounds + periods < n)
        bounds, periods = bounds[fit], periods[fit]
        reached: dict[int, int] = {}
        many = {int(c) for c, k in zip(*np.unique(bounds, return_counts=True)) if k > MANY}
        at, ahead, back = -1, None, None
        for c, q in zip(bounds.tolist(), periods.tolist()):
            if reached.get(q, -1) > c:
                continue
            if c in many:
                if c != at:
                    at, ahead = c, z_values(codes[c:].tolist())
                    # the text before boundary + period, reversed, against the text before the boundary: one Z-array
                    tail = min(n, c + 2 * octave)
                    back = z_values([*codes[:c][::-1].tolist(), -1, *codes[:tail][::-1].tolist()])[c + 1:]
                    ends = tail
                right, left = int(ahead[q]), int(min(back[ends - c - q], c))
            else:
                right = _common(codes[c:n - q], codes[c + q:])
                left = _common(codes[:c][::-1], codes[q:c + q][::-1])
            reached[q] = c + right if right else c + 1
            if left + right >= least_interval(q):
                out.append((q, c - left, c + right))
        octave *= 2
    return list(dict.fromkeys(out))


def tile_plan(n: int, tile: int = TILE) -> list[tuple[int, int, int, int]]:
    """(start, end, lowest period, highest period) of the tiles of a document of n words that needs several."""
    plan, low, most = [], 1, n // REPEATS
    high = tile // TILE_OCTAVES * 2 - 1
    while low <= most:
        octave = (high + 1) // 2
        size, step = TILE_OCTAVES * octave, STEP_OCTAVES * octave
        if size >= n:
            plan.append((0, n, low, most))
            break
        plan += [(start, min(n, start + size), low, min(high, most)) for start in range(0, n - low, step)]
        low, high = high + 1, high * 2 + 1
    return plan


def word_codes(words: list[bytes], first: int = 0) -> np.ndarray:
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), dtype=np.int64, count=len(words)) + first


def runs_of_words(docs: DataFrame, scratch: Scratch, rewrite=None, keep_text: bool = False,
                  tile: int = TILE) -> DataFrame:
    """``(row, doc_id, n_words, plain_sha256, words, runs)`` of every row.

    ``runs`` is array<struct<start, length, period>> by start, then period, NULL without any; ``words`` (one space
    between two) is there for rows with runs, or for all with ``keep_text``. ``rewrite(doc_id, words)`` may change the
    words before they are searched.
    """
    def scan(batches):
        task, number = TaskContext.get(), 0
        first = task.partitionId() << 33
        rows, codes, total = [], [], 0

        def solve():
            nonlocal rows, codes, total
            owners = [r for r in rows if r["tile"]]
            starts = np.array([r["at"] for r in owners], dtype=np.int64)
            longest = max((r["n_words"] for r in owners), default=0)
            if longest >= LEAST:
                for q, s, e in fragments(np.concatenate(codes), 1, longest // REPEATS):
                    owner = owners[int(np.searchsorted(starts, s, side="right")) - 1]
                    span = s - owner["at"], e + q - owner["at"]
                    owner["found"][span] = min(q, owner["found"].get(span, q))
            for r in rows:
                runs = [{"start": s, "length": e - s, "period": q} for (s, e), q in sorted(r["found"].items())]
                keep = keep_text or runs or not r["tile"]
                yield {"row": r["row"], "doc_id": r["doc_id"], "n_words": r["n_words"], "plain_sha256": r["plain"],
                       "words": r["words"].decode() if keep else None, "runs": sorted(runs, key=lambda x: (x["start"], x["period"])) or None,
                       "tiled": not r["tile"], "at": None, "low": None, "high": None, "codes": None}
                if not r["tile"]:
                    own = word_codes(r["words"].split())
                    for start, end, low, high in tile_plan(r["n_words"], tile):
                        yield {"row": r["row"], "doc_id": None, "n_words": None, "plain_sha256": None, "words": None,
                               "runs": None, "tiled": None, "at": start, "low": low, "high": high,
                               "codes": own[start:end].astype(np.int32).tobytes()}
            rows, codes, total = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split() if text else []
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                joined = b" ".join(words)
                row = {"row": first + number, "doc_id": doc_id, "n_words": len(words), "words": joined, "found": {},
                       "plain": hashlib.sha256(joined).hexdigest(), "tile": len(words) <= tile, "at": total}
                number += 1
                rows.append(row)
                if row["tile"]:
                    codes.append(word_codes(words, total))  # codes of their own: no word equals one of another document
                    total += len(words)
                if total > BATCH_WORDS or not row["tile"]:
                    yield from _batches(solve())
        yield from _batches(solve())

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = scratch.save(slim.mapInArrow(scan, f"row long, doc_id long, n_words long, plain_sha256 string, words string, runs {RUNS}, "
                                              "tiled boolean, at long, low long, high long, codes binary"), "read")
    columns = ["row", "doc_id", "n_words", "plain_sha256", "words"]
    tiles = read.where("codes is not null").select("row", "at", "low", "high", "codes")

    def solve_tiles(batches):
        for batch in batches:
            for r in batch.to_pylist():
                got = fragments(np.frombuffer(r["codes"], dtype=np.int32).astype(np.int64), r["low"], r["high"])
                if got:
                    found = np.array(got, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), r["row"])), pa.array(found[:, 0]), pa.array(found[:, 1] + r["at"]),
                         pa.array(found[:, 2] + r["at"])], names=["row", "q", "s", "e"])

    parts = tiles.repartition("row", "at", "low").mapInArrow(solve_tiles, "row long, q long, s long, e long")
    run = F.struct("start", "period", "length")
    stitched = stitch(parts).groupBy(F.col("row").alias("__row")).agg(F.transform(
        F.array_sort(F.collect_list(run)),
        lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period"))).alias("runs"))
    tiled = scratch.read("read").where("tiled").select(columns)
    return read.where("not tiled").select(*columns, "runs").union(
        tiled.join(stitched, F.col("row") == F.col("__row"), "left").select(*columns, "runs"))


def _batches(rows, most: int = 4 << 20):
    """Arrow batches of the rows, each of about ``most`` bytes of words and codes."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("plain_sha256", pa.string()), ("words", pa.string()),
        ("runs", pa.list_(kind)), ("tiled", pa.bool_()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("codes", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row["words"] or "") + len(row["codes"] or b"")
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def stitch(parts: DataFrame) -> DataFrame:
    """Whole runs ``(row, start, length, period)`` from fragments ``(row, q, s, e)`` that touch or overlap."""
    order = Window.partitionBy("row", "q").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("__new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("row", "q", "__island").agg(F.min("s").alias("start"), (F.max("e") + F.col("q")).alias("end"))
    whole = whole.where((F.col("end") - F.col("start") >= LEAST) & (F.col("end") - F.col("start") >= REPEATS * F.col("q")))
    return whole.groupBy("row", "start", "end").agg(F.min("q").alias("period")).select(
        "row", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def kept_words(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, stay.tolist()) if k]


def collapsed_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, runs, text)`` of every row: the runs, and the words without the repeats, one space between two."""
    scratch = Scratch(docs.sparkSession, "runs")
    found = runs_of_words(docs, scratch, keep_text=True).select("doc_id", "runs", "words")

    def collapse(batches):
        for batch in batches:
            texts = [b" ".join(kept_words((w or "").encode().split(), r or [])).decode()
                     for r, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["doc_id", "runs", "text"])

    return found.mapInArrow(collapse, f"doc_id long, runs {RUNS}, text string")


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: one document in ten repeats a stretch of its words to its end; none without an id."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


#: Fixed: the columns of the report.
REPORT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, its longest one and digests of all runs and of the collapsed words."""
    scratch = Scratch(docs.sparkSession, "runs")
    found = runs_of_words(docs, scratch, with_planted_period).select("doc_id", "plain_sha256", "words", "runs")
    none = hashlib.sha256(b"").hexdigest()

    def digest(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                runs = r["runs"]
                if not runs:
                    out.append((r["doc_id"], 0, None, None, None, None, none, r["plain_sha256"]))
                    continue
                best = min(runs, key=lambda x: (-x["length"], x["start"], x["period"]))
                lines = "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in runs)
                out.append((r["doc_id"], len(runs), *best.values(), 1000 * best["length"] // best["period"],
                            hashlib.sha256(lines.encode()).hexdigest(),
                            hashlib.sha256(b" ".join(kept_words(r["words"].encode().split(), runs))).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(REPORT, x)) for x in out],
                                             schema=pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in REPORT]))

    return found.mapInArrow(digest, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in REPORT))
