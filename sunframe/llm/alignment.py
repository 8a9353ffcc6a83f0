"""Alignment of two tokenizers by products of sparse incidence matrices.

A token is a row over the bytes it covers. With the token-byte incidence of both tokenizers, A and B, the product
A x B' has an entry for every pair of tokens that overlap: the number of bytes they share. Offsets at which tokens of
both end cut the tokens into groups; the product of the two token-group incidences links all pairs of one group. The
matrices are compressed rows built here (:class:`Csr`); products go row by row after Gustavson, many rows at once.

Neither tokenizer joins anything over a space that follows a character other than white space (the byte-level one
splits there first, the piece vocabulary has no piece with a space after another character; where a vocabulary has
one, nothing is cut). So a text is the sequence of its segments between such places, groups lie inside segments, and the
products are made once per distinct segment of a worker's memory: documents are sums and sequences of segments.

Counts over the corpus: tasks add up pairs per chunk of whole documents, Spark adds up chunks, and each chunk gets
back the counts of its own pairs, joined by pair, never the whole table. Chunks are written once, in small row groups, and
read again; each meets its counts as a group of its own.

Defined cases: texts that are NULL, empty, or not reproduced byte by byte by both tokenizers have no tokens; special
strings are plain text; repeated rows and repeated or NULL ids return a row each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tools import Scratch

BYTE_VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Fixed: how a piece vocabulary writes a space.
SPACE = "▁"
#: Characters of text whose documents make one chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 4 << 20
#: Segments a worker remembers, and the longest one worth it.
REMEMBER, LONGEST = 200_000, 64
#: Before a space that follows another character, unless nothing but spaces comes after it.
SEGMENT = re.compile(r"(?<=\S)(?= +\S)")
#: Where cutting at every space would be wrong.
UNEVEN = re.compile(r"\s | \Z")
#: Bytes whose products are made at once.
BLOCK = 1 << 18
#: Rows of chunks are some MB each, and Parquet's writers and readers hold a row group: it is closed after about this many bytes,
#: counted after each row instead of after a hundred. Statistics would keep two whole values per row group until the file is closed.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
              "parquet.column.statistics.enabled": "false"}


class Csr:
    """Compressed sparse rows: row i has the columns ``indices[indptr[i]:indptr[i + 1]]`` with values ``data``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, columns: int):
        self.indptr, self.indices, self.data, self.columns = indptr, indices, data, columns

    @classmethod
    def ranges(cls, starts: np.ndarray, ends: np.ndarray, columns: int) -> "Csr":
        """Row i covers the columns from ``starts[i]`` up to ``ends[i]``."""
        lengths = ends - starts
        indptr = np.concatenate([[0], np.cumsum(lengths)])
        indices = np.arange(indptr[-1]) + np.repeat(starts - indptr[:-1], lengths)
        return cls(indptr, indices, np.ones(len(indices), dtype=np.int64), columns)

    def transposed(self) -> "Csr":
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, rows[order], self.data[order], len(self.indptr) - 1)

    def rows(self, start: int, end: int) -> "Csr":
        a, b = self.indptr[start], self.indptr[end]
        return Csr(self.indptr[start:end + 1] - a, self.indices[a:b], self.data[a:b], self.columns)

    def times(self, other: "Csr") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product: each row is the sum of the other's rows that its entries name."""
        width = np.diff(other.indptr)[self.indices]
        at = np.repeat(other.indptr[self.indices] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        row = np.repeat(np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), width)
        key = row * other.columns + other.indices[at]
        value = np.repeat(self.data, width) * other.data[at]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(value, first) if len(first) else value
        return key[first] // other.columns, key[first] % other.columns, total


def product(a: Csr, b: Csr, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A x B' in blocks of rows that hold about ``block`` entries."""
    turned, parts, start, rows = b.transposed(), [], 0, len(a.indptr) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(a.indptr, a.indptr[start] + block, side="right")) - 1)
        i, j, v = a.rows(start, end).times(turned)
        parts.append((i + start, j, v))
        start = end
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (none, none, none)


def bytes_of_units(vocabulary: dict[str, int], size: int) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, which writes bytes as printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    back = {c: b for b, c in shown.items()}
    out = [b""] * size
    for unit, i in vocabulary.items():
        if all(c in back for c in unit):
            out[i] = bytes(back[c] for c in unit)
    return out


class Tokenizers:
    """Both tokenizers of a worker and the bytes of their ids."""

    def __init__(self, json_path: str, rank_path: str, model_path: str):
        import sentencepiece

        self.a = tokens.encoder(json_path, rank_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(json_path, encoding="utf-8") as f:
            self.a_bytes = bytes_of_units(json.load(f)["model"]["vocab"], self.a.size)
        self.b_size = len(self.b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i in range(self.b_size) for p in [self.b.id_to_piece(i)]]
        self.a_lengths = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.a_names, self.b_names = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(self.b_size)]
        #: No piece goes on with a space after another character, and spaces are kept as they are.
        self.cuts = not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b_size)) and all(
            self.b.encode(x, out_type=str) == y for x, y in (("a  b", [f"{SPACE}a", SPACE, f"{SPACE}b"]), ("b", [f"{SPACE}b"])))

    def segments(self, text: str) -> list[str]:
        """The segments of space + text, each without the space it begins with."""
        if not self.cuts:
            return [text]
        if not UNEVEN.search(f" {text}"):
            return text.split(" ")
        return [s[1:] for s in SEGMENT.split(f" {text}")]

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of each segment with its space by A and B, and whether both spell it byte by byte."""
        a = [self.a.plain(f" {s}") for s in segments]
        b = self.b.encode(segments, num_threads=1) if segments else []
        ok = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == (own := f" {s}".encode())
                       and b"".join(map(self.b_bytes.__getitem__, y)) == own for s, x, y in zip(segments, a, b)], dtype=bool)
        return a, b, ok


class Alignment:
    """Tokens, overlap links, groups and shared-group links of texts (or segments) that both tokenizers spell."""

    def __init__(self, a_ids: list[list[int]], b_ids: list[list[int]], a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a_counts, self.b_counts = np.array([len(x) for x in a_ids], dtype=np.int64), np.array([len(x) for x in b_ids], dtype=np.int64)
        self.a = np.fromiter((i for x in a_ids for i in x), dtype=np.int64, count=int(self.a_counts.sum()))
        self.b = np.fromiter((i for x in b_ids for i in x), dtype=np.int64, count=int(self.b_counts.sum()))
        # one byte axis for all texts: they follow each other, and each ends at the same byte in A and in B
        self.a_ends, self.b_ends = np.cumsum(a_lengths[self.a]), np.cumsum(b_lengths[self.b])
        self.bytes = int(self.a_ends[-1]) if len(self.a) else 0
        self.a_text = np.repeat(np.arange(len(a_ids)), self.a_counts)
        self.rows = Csr.ranges(self.a_ends - a_lengths[self.a], self.a_ends, self.bytes)
        self.columns = Csr.ranges(self.b_ends - b_lengths[self.b], self.b_ends, self.bytes)
        cuts = np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(cuts, self.a_ends), np.searchsorted(cuts, self.b_ends)
        self.n_groups = len(cuts)
        self.group_text = self.a_text[np.searchsorted(self.a_ends, cuts)] if len(cuts) else cuts

    def overlaps(self):
        """(A token, B token, shared bytes) of all tokens that overlap."""
        return product(self.rows, self.columns)

    def links(self):
        """(A token, B token) of those overlaps that end at the same byte."""
        i, j, _ = self.overlaps()
        together = self.a_ends[i] == self.b_ends[j]
        return i[together], j[together]

    def group_rows(self) -> tuple[Csr, Csr]:
        """Token-group incidences of A and B."""
        return Csr.ranges(self.a_group, self.a_group + 1, self.n_groups), Csr.ranges(self.b_group, self.b_group + 1, self.n_groups)

    def shared_groups(self):
        """(A token, B token) of all pairs in one group."""
        i, j, _ = product(*self.group_rows())
        return i, j

    def group_strings(self, a_names: list[str], b_names: list[str]) -> list[str]:
        """``a1,a2|b1`` of each group, ids in order."""
        a, b = (g.transposed().indptr.tolist() for g in self.group_rows())
        a_ids, b_ids = [a_names[i] for i in self.a.tolist()], [b_names[i] for i in self.b.tolist()]
        return [",".join(a_ids[a[g]:a[g + 1]]) + "|" + ",".join(b_ids[b[g]:b[g + 1]]) for g in range(self.n_groups)]


class Segment:
    """What documents need of a segment."""

    __slots__ = ("ok", "a", "b", "groups", "text", "pairs")

    def __init__(self, ok, a, b, groups, text, pairs):
        self.ok, self.a, self.b, self.groups, self.text, self.pairs = ok, a, b, groups, text, pairs


class SegmentTable:
    """Segments by their text, remembered up to a bound."""

    def __init__(self, tokenizers: Tokenizers, remember: int = REMEMBER):
        self.tokenizers, self.remember, self.known = tokenizers, remember, {}

    def get(self, segments: list[str]) -> list[Segment]:
        known = self.known
        new = [s for s in segments if s not in known]
        if len(known) + len(new) > self.remember:
            known = self.known = {s: known[s] for s in segments if s in known}
        met, size = {}, 0
        part: list[str] = []
        for s in new:
            part.append(s)
            size += len(s)
            if size > BLOCK:
                met.update(zip(part, self.made(part)))
                part, size = [], 0
        met.update(zip(part, self.made(part)))
        out = [known.get(s) or met[s] for s in segments]
        known.update((s, x) for s, x in met.items() if len(s) <= LONGEST)
        return out

    def made(self, segments: list[str]) -> list[Segment]:
        t = self.tokenizers
        a, b, ok = t.encoded(segments)
        good = np.flatnonzero(ok)
        al = Alignment([a[i] for i in good], [b[i] for i in good], t.a_lengths, t.b_lengths)
        i, j = al.links()
        keys, of = al.a[i] * t.b_size + al.b[j], al.a_text[i]
        at = np.searchsorted(of, np.arange(len(good) + 1))
        strings, groups_at = al.group_strings(t.a_names, t.b_names), np.searchsorted(al.group_text, np.arange(len(good) + 1)).tolist()
        out = [Segment(False, 0, 0, 0, "", ())] * len(segments)
        for n, g in enumerate(good.tolist()):
            first, last = groups_at[n], groups_at[n + 1]
            out[g] = Segment(True, len(a[g]), len(b[g]), last - first, ";".join(strings[first:last]), keys[at[n]:at[n + 1]])
        return out


_TOKENIZERS: dict[tuple, Tokenizers] = {}


def tokenizers(byte_vocabulary, piece_vocabulary: str) -> Tokenizers:
    """One pair per worker process; the files are found where the worker runs."""
    key = (*byte_vocabulary, piece_vocabulary)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(*(tokens.vocabulary_path(n) for n in key))
    return _TOKENIZERS[key]


def whole_text(t: Tokenizers, text: str) -> Segment | None:
    """The text in one piece; NULL unless both tokenizers spell it."""
    a, b, ok = t.encoded([text])
    return SegmentTable(t).made([text])[0] if ok[0] else None


def token_links(docs: DataFrame, byte_vocabulary=BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """``(doc_id, a_ids, b_ids, overlaps, shared_groups)`` of every row.

    ``overlaps`` has a struct (a, b, bytes) for each pair of token places that share bytes, ``shared_groups`` one (a, b)
    for each pair in one group; both in order.
    """
    def scan(batches):
        t = tokenizers(byte_vocabulary, piece_vocabulary)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b, ok = t.encoded([text or ""])
                if not text or not ok[0]:
                    a, b = [[]], [[]]
                al = Alignment(a, b, t.a_lengths, t.b_lengths)
                out.append({"doc_id": doc_id, "a_ids": a[0], "b_ids": b[0],
                            "overlaps": [dict(zip(("a", "b", "bytes"), x)) for x in zip(*(v.tolist() for v in al.overlaps()))],
                            "shared_groups": [dict(zip(("a", "b"), x)) for x in zip(*(v.tolist() for v in al.shared_groups()))]})
                if sum(len(r["overlaps"]) for r in out) > 1 << 18:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    place = pa.int64()
    schema = pa.schema([("doc_id", place), ("a_ids", pa.list_(place)), ("b_ids", pa.list_(place)),
                        ("overlaps", pa.list_(pa.struct([("a", place), ("b", place), ("bytes", place)]))),
                        ("shared_groups", pa.list_(pa.struct([("a", place), ("b", place)])))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id long, a_ids array<long>, b_ids array<long>, overlaps array<struct<a:long,b:long,bytes:long>>, "
              "shared_groups array<struct<a:long,b:long>>")


CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, "
         "doc_at binary, codes binary, link_at binary, links binary, pairs array<long>, times array<long>")


def chunked(docs: DataFrame, byte_vocabulary, piece_vocabulary: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows of whole documents: their digests, their segments, the links of each segment, and how often a pair is linked."""
    def scan(batches):
        t = tokenizers(byte_vocabulary, piece_vocabulary)
        table, first, number = SegmentTable(t), TaskContext.get().partitionId() << 32, 0
        doc_ids, coded, local, chars = [], [], {}, 0

        def chunk():
            known = table.get(list(local))
            spelled = np.array([s.ok for s in known], dtype=bool)
            for n, (codes, text) in enumerate(coded):
                if len(codes) and not spelled[codes].all():  # as one piece it may still come out right
                    whole = whole_text(t, text)
                    coded[n] = (np.array([len(known)] if whole else [], dtype=np.uint32), None)
                    known += [whole] if whole else []
            parts = np.array([[s.a, s.b, s.groups] for s in known], dtype=np.int64).reshape(-1, 3)
            strings = [s.text for s in known]
            keys = [s.pairs for s in known]
            link_at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
            pairs, links = np.unique(np.concatenate([*keys, np.zeros(0, dtype=np.int64)]), return_inverse=True)
            doc_at = np.concatenate([[0], np.cumsum([len(c) for c, _ in coded])]).astype(np.int64)
            codes = np.concatenate([c for c, _ in coded]).astype(np.uint32)
            used = np.bincount(codes, minlength=len(known))
            times = np.bincount(links, weights=np.repeat(used, np.diff(link_at)), minlength=len(pairs)).astype(np.int64)
            sums = np.concatenate([np.zeros((1, 3), dtype=np.int64), np.cumsum(parts[codes], axis=0)])
            sums = sums[doc_at[1:]] - sums[doc_at[:-1]]
            sha = [hashlib.sha256(";".join(map(strings.__getitem__, c.tolist())).encode()).hexdigest() if len(c) else ""
                   for c, _ in coded]
            return pa.RecordBatch.from_pylist([{
                "chunk": first + number, "doc_id": doc_ids, "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2],
                "sha": sha, "doc_at": doc_at.tobytes(), "codes": codes.tobytes(), "link_at": link_at.tobytes(),
                "links": links.astype(np.uint32).tobytes(), "pairs": pairs, "times": times}], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_ids and chars + len(text or "") > chunk_chars:
                    yield chunk()
                    doc_ids, coded, local, chars, number = [], [], {}, 0, number + 1
                put = local.setdefault
                codes = [put(s, len(local)) for s in t.segments(text)] if text else []
                doc_ids.append(doc_id)
                coded.append((np.array(codes, dtype=np.uint32), text))
                chars += len(text or "")
        if doc_ids:
            yield chunk()

    numbers = pa.list_(pa.int64())
    schema = pa.schema([("chunk", pa.int64()), *((c, numbers) for c in ("doc_id", "n_a", "n_b", "n_groups")),
                        ("sha", pa.list_(pa.string())), *((c, pa.binary()) for c in ("doc_at", "codes", "link_at", "links")),
                        ("pairs", numbers), ("times", numbers)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, CHUNK)


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """``(pair, count, best)`` of every linked id pair; best: no pair of the same B id has a higher count."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    highest = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))
    # one row per id of the vocabulary, whatever the corpus
    return (counts.join(F.broadcast(highest), F.col("pair") % b_size == F.col("b"))
            .select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def alignment_report(docs: DataFrame, byte_vocabulary=BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
                     chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: tokens, groups and links, how many links are their B id's most frequent, and a digest."""
    import sentencepiece

    b_size = len(sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(piece_vocabulary)))
    scratch = Scratch(docs.sparkSession, "alignment")
    chunks = scratch.save(chunked(docs, byte_vocabulary, piece_vocabulary, chunk_chars), "chunks", **ROW_GROUPS)
    counts = scratch.save(pair_counts(chunks, b_size), "counts")
    asked = scratch.read("chunks").select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair"))
    told = asked.join(counts.hint("merge"), "pair").select("of", "pair", "count", F.col("best").cast("long").alias("best"))

    def digest(chunk: pa.Table, known: pa.Table) -> pa.Table:
        r = {n: chunk.column(n)[0] for n in chunk.column_names}
        codes, links = (np.frombuffer(r[n].as_buffer(), dtype=np.uint32) for n in ("codes", "links"))
        doc_at, link_at = (np.frombuffer(r[n].as_buffer(), dtype=np.int64) for n in ("doc_at", "link_at"))
        order = np.argsort(known.column("pair").to_numpy())

        def sums(per_link: np.ndarray) -> np.ndarray:
            """Per document the sum over the links of its segments."""
            upto = np.concatenate([[0], np.cumsum(per_link)])
            upto = np.concatenate([[0], np.cumsum((upto[link_at[1:]] - upto[link_at[:-1]])[codes])])
            return upto[doc_at[1:]] - upto[doc_at[:-1]]

        best, count = (known.column(n).to_numpy()[order][links] for n in ("best", "count"))
        return pa.table({**{n: r[n].values for n in ("doc_id", "n_a", "n_b", "n_groups")}, "n_links": sums(np.ones(len(links), dtype=np.int64)),
                         "n_best": sums(best), "count_sum": sums(count), "groups_sha256": r["sha"].values})

    # one chunk and its counts at a time: a task's memory does not follow the number of its chunks
    return scratch.read("chunks").drop("pairs", "times").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(
        digest, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
