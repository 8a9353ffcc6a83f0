import hashlib
import random
import zlib

import numpy as np
import pytest

from sunframe.llm import periodic_runs
from sunframe.llm.tools import Scratch


def brute_runs(x):
    """Every run by comparing all places at all distances: (start, length, period)."""
    seen = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                seen.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def random_sequence(rng):
    n, letters = rng.randint(1, 150), rng.choice([1, 2, 3, 5, 40])
    x = [rng.randrange(letters) for _ in range(n)]
    if rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        x = x[:a] + [x[a + i % min(p, n - a)] for i in range(n - a)]
    return x + [rng.randrange(letters) for _ in range(rng.choice([0, 0, 40]))]


@pytest.mark.parametrize("many", [0, 256])
def test_fragments_of_one_tile(many, monkeypatch):
    monkeypatch.setattr(periodic_runs, "MANY", many)  # 0: the linear Z-algorithm at every boundary
    rng = random.Random(5)
    for _ in range(250):
        x = random_sequence(rng)
        found = {}
        for q, s, e in periodic_runs.fragments(np.array(x, dtype=np.int64), 1, len(x) // 2):
            found[s, e + q] = min(found.get((s, e + q), q), q)
        assert sorted((s, e - s, q) for (s, e), q in found.items()) == brute_runs(x), x


def test_z_values():
    assert periodic_runs.z_values(list("aabaab")).tolist() == [0, 1, 0, 3, 1, 0]


def test_tiles_are_stitched(spark):
    """With tiles of 64 words nearly every document is cut; whole runs come out as from one piece."""
    rng = random.Random(9)
    rows = []
    for i in range(24):
        x = [w for _ in range(rng.randint(1, 6)) for w in random_sequence(rng)]
        if i % 6 == 0:  # a long period over most of a long document
            x = [rng.randrange(50) for _ in range(330)] * 4 + x
        rows.append((i, " ".join(f"w{w}" for w in x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.runs_of_words(docs, Scratch(spark, "runs-test"), tile=64).collect()
    for r in got:
        words = dict(rows)[r.doc_id].split()
        assert [tuple(x) for x in r.runs or []] == brute_runs(words), r.doc_id


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words) if n < 3000 else None
    if runs is None:
        return None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_report_against_brute_force(spark, odd_docs, sf):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        report = periodic_runs.run_report(docs)
        assert report.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        got = [tuple(r) for r in report.collect()]
        assert len(got) == len(rows)
        want = [e for r in rows if (e := expected(*r))]
        left = list(got)
        for w in want:
            left.remove(w)
        assert len(left) == len(rows) - len(want)


def test_empty_table_and_collapse(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.run_report(empty).collect() == []
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, None), (2, "no  run\there")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.runs for r in periodic_runs.collapsed_documents(docs).collect()}
    assert set(got) == {(1, "x a b c y"), (2, ""), (2, "no run here")}
    assert [tuple(r) for r in got[1, "x a b c y"]] == [(1, 15, 3)]
