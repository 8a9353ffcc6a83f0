import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sunframe.llm import alignment
from sunframe.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def direct():
    """Both tokenizers as their own libraries offer them, whole texts at once."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    a_bytes = alignment.bytes_of_units(vocabulary, 50257)

    def encode(text):
        if not text:
            return [], []
        x = [(i, a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
             for i in b.encode(text)]
        want = (" " + text).encode()
        good = b"".join(p for _, p in x) == want == b"".join(p for _, p in y)
        return (x, y) if good else ([], [])

    return encode


def ends(pieces):
    out, at = [], 0
    for i, p in pieces:
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def brute_report(rows, encode):
    per, count = [], Counter()
    for doc_id, text in rows:
        x, y = (ends(p) for p in encode(text))
        by_end = {f: j for j, _, f in y}
        links = [(i, by_end[e]) for i, _, e in x if e in by_end]
        if len(x) < 60:
            assert links == [(i, j) for i, _, e in x for j, _, f in y if e == f]
        count.update(links)
        cuts = sorted({e for _, _, e in x} & by_end.keys())
        by_a, by_b = defaultdict(list), defaultdict(list)
        for side, tokens in ((by_a, x), (by_b, y)):
            for i, _, e in tokens:
                side[bisect.bisect_left(cuts, e)].append(str(i))
        groups = [",".join(by_a[g]) + "|" + ",".join(by_b[g]) for g in range(len(cuts))]
        per.append((doc_id, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return sorted(((d, a, b, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha)
                   for d, a, b, g, links, sha in per), key=repr)


ODD = ["", " ", "  ", "foo ", "foo  ", " foo", "  foo bar", "a<s>b</s><unk> <|endoftext|>", "<0x41> <0x0A>", "x▁y z", "a\x00b",
       "\n", "a\xa0b　c ｅ", "é é ﬁ", "line\n next \n line  two\t x", "tab\there it's we'll", "日本語テキスト 中文", "😀 👩‍👩‍👧 x", "a" * 700,
       "1234567890 " * 50, "\r\n\r\n a", "x   y", "end\x1c  z", "'s 't", None]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m, k, n = rng.integers(1, 12, 3)
        a, b = (rng.random((r, k)) < 0.4 for r in (m, n))
        csr = [alignment.Csr(np.concatenate([[0], np.cumsum(d.sum(axis=1))]), np.nonzero(d)[1], np.ones(d.sum(), dtype=np.int64), int(k))
               for d in (a, b)]
        i, j, v = alignment.product(*csr, block=int(rng.integers(1, 10)))
        got = np.zeros((m, n), dtype=np.int64)
        got[i, j] = v
        assert (got == a.astype(int) @ b.T.astype(int)).all()


def test_segments_join_to_whole_texts(direct):
    t = alignment.tokenizers(alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)
    assert t.cuts
    rng = random.Random(4)
    texts = [x for x in ODD if x] + ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "\xa0", ".", "9", "é", "▂", "'s", " the"])
                                             for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        x, y = direct(text)
        parts = t.segments(text)
        assert "".join(f" {s}" for s in parts) == f" {text}"
        a, b, ok = t.encoded(parts)
        if x:
            assert ok.all() and [i for p in a for i in p] == [i for i, _ in x] and [i for p in b for i in p] == [i for i, _ in y], repr(text)
        else:
            assert not ok.all()


def test_report_against_brute_force(spark, odd_docs, sf, direct):
    extra = spark.createDataFrame([(900 + i, x) for i, x in enumerate(ODD)] + [(900, "foo ")], "doc_id long, text string")
    for docs in (odd_docs, extra, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        for size in (alignment.CHUNK_CHARS, 500):  # also with many chunks
            report = alignment.alignment_report(docs, chunk_chars=size)
            assert report.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            got = sorted((tuple(r) for r in report.collect()), key=repr)
            assert got == brute_report(rows, direct)


def test_links_of_tokens(spark, direct):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    for r in alignment.token_links(docs).collect():
        x, y = (ends(p) for p in direct(ODD[r.doc_id]))
        assert r.a_ids == [i for i, _, _ in x] and r.b_ids == [j for j, _, _ in y]
        assert [tuple(o) for o in r.overlaps] == [(i, j, min(e, f) - max(s, t)) for i, (_, s, e) in enumerate(x)
                                                  for j, (_, t, f) in enumerate(y) if s < f and t < e]
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        group = [[int(np.searchsorted(cuts, e)) for *_, e in side] for side in (x, y)]
        assert [tuple(o) for o in r.shared_groups] == [(i, j) for i, g in enumerate(group[0]) for j, h in enumerate(group[1]) if g == h]


def test_empty_table(spark):
    assert alignment.alignment_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_follows_a_chunk_and_not_a_task(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    class Kept(alignment.Scratch):
        def __init__(self, session, label):
            super().__init__(session, label)
            made.append(self)

    made = []
    monkeypatch.setattr(alignment, "Scratch", Kept)
    monkeypatch.setitem(alignment.ROW_GROUPS, "parquet.block.size", str(100_000))
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2_000))) for i in range(30)],
                                 "doc_id long, text string").coalesce(1)  # thirty chunks of one task, in one row group before
    report = alignment.alignment_report(docs, chunk_chars=10_000)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    assert report.count() == 30
    groups = []
    for file in spark.read.parquet(f"{made[0].root}/chunks").inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file:")).metadata
        groups += [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30 and max(g.num_rows for g in groups) <= 10
