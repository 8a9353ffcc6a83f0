"""Document operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sunframe.llm import bfd_packing, curriculum, hmm, langid, pii, retrieval_packing, simhash
from sunframe.llm.tokens import encoder, vocabulary_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(params=["odd", "table"])
def any_docs(request, odd_docs, docs):
    return odd_docs if request.param == "odd" else docs


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def crc(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


# near-duplicates

def fingerprint(text):
    words = SPACE.findall(lower(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_near_duplicates(any_docs):
    rows = any_docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    want = Counter((r.doc_id, f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    got = Counter(tuple(r) for r in simhash.near_duplicates(any_docs).collect())
    assert got == want
    kept = simhash.keep_representatives(any_docs)
    assert kept.columns == any_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(ids) == Counter(least.get(root) for root in {find(i) for i in range(len(rows))})


def test_pairs_in_sliced_buckets(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.int64)
    fps = {int(c) ^ int(m) for c in centre for m in
           (sum(1 << int(b) for b in rng.choice(63, 2, replace=False)) for _ in range(120))}
    table = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    for rows in (2048, 16):
        links = simhash.fingerprint_links(table, slice_rows=rows).collect()
        got = {f: f for f in fps}

        def find(x):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in links:
            assert (a ^ b) & ((1 << 64) - 1) != 0
            got[find(a)] = find(b)
        for a in fps:
            for b in fps:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                    assert find(a) == find(b)


def test_pivots_discard_nothing_near():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64),
                                    np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))]))
    i, j = simhash.near_pairs(fps, simhash.reference_fingerprints())
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want


# language

def test_language(odd_docs, spark):
    got = langid.predictions(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0.0 <= r.score <= 1.0
        assert r.held_out == (crc(r.doc_id, 4) == 2)
    for i in (102, 103, 104, 105, 111):
        assert by_id[i][0].lang_pred == "und"
    assert all(by_id[i][0].lang_pred == ("en" if i % 2 == 0 else "de") for i in range(60))
    assert langid.predictions(odd_docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predictions(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).where("false")).collect()} == set()
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


# mixture

def test_mixture(any_docs):
    rows = any_docs.select("doc_id", "source", "text").collect()
    sizes, words = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += len(SPACE.findall(r.text or ""))
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = [s for s in free if target[s] > 2 * sizes[s] * (1 + 1e-12)]
        if not over:
            break
        capped |= set(over)
    got = curriculum.mix_report(any_docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(SPACE.findall(r.text or ""))) for r in rows)
    goal = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        goal[r.source_size, round(r.target, 6)] = goal.get((r.source_size, round(r.target, 6)), 0) + r.taken
    want = {(sizes[s], round(target[s], 6)) for s in order}
    assert set(goal) == want
    assert all(abs(taken - t) <= 1 or sum(1 for s in order if (sizes[s], round(target[s], 6)) == (n, t)) > 1
               for (n, t), taken in goal.items())
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and (not places or (0 <= places[0] and places[-1] <= 1))
    again = curriculum.mix_report(any_docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = curriculum.mixed_documents(any_docs)
    assert mixed.columns == any_docs.columns
    taken = sum(len(SPACE.findall(r.text)) for r in mixed.select("text").collect())
    assert taken == sum(r.taken for r in got)


def test_schedule_inverse(spark):
    from pyspark.sql import functions as F

    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s, k) for s in shares for k in range(3)], "share double, place long")
    for r in df.select("*", curriculum.demand_time(F.col("share"), F.col("place")).alias("t")).collect():
        a, b, c = curriculum.SCHEDULES[r.place]
        grid = np.linspace(0, r.t, 20001)
        curve = np.interp(grid, [0, 0.5, 1], [a, b, c])
        area = np.trapezoid(curve, grid) / ((a + b) / 4 + (b + c) / 4)
        assert abs(area - r.share) < 1e-6


# packing

def ids_of(text):
    enc = encoder(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"))
    return np.array(enc.exact.encode(text or "", add_special_tokens=False).ids + [1])


def test_retrieval_packing(any_docs):
    texts = defaultdict(list)
    for r in any_docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    rows = retrieval_packing.pack(any_docs).collect()
    windows, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        parts[r.doc_id].append(r)
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    padding = 0
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    for doc, pieces in parts.items():
        if len(texts[doc]) == 1:
            whole = np.concatenate([np.frombuffer(p.ids, "<u2") for p in sorted(pieces, key=lambda p: p.start)])
            assert np.array_equal(whole, ids_of(texts[doc][0]))
            assert {p.doc_tokens for p in pieces} == {len(whole)}
    total = sum(len(ids_of(t)) for ts in texts.values() for t in ts)
    assert sum(r.length for r in rows) == total


def test_neighbours_follow_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, rng.integers(5, 60)) for _ in range(40)]
    terms, tfs = zip(*[np.unique(d, return_counts=True) for d in docs])
    df = np.bincount(np.concatenate(terms), minlength=50)
    idf = np.log(1 + (40 - df + 0.5) / (df + 0.5)).astype(np.float32)
    lengths = np.array([len(d) for d in docs])
    index = retrieval_packing.Index(list(terms), list(tfs), idf, lengths, lengths.mean())
    for seed in range(40):
        score = np.zeros(40)
        for d in range(40):
            tf = dict(zip(terms[d].tolist(), tfs[d].tolist()))
            norm = 1.2 * (1 - 0.75 + 0.75 * lengths[d] / lengths.mean())
            score[d] = sum(idf[t] * tf[t] * 2.2 / (tf[t] + norm) for t in terms[seed].tolist() if t in tf)
        order = index.neighbours(seed)
        assert np.all(np.diff(score[order]) <= 1e-4)


def test_best_fit_plan_equals_one_by_one():
    rng = np.random.default_rng(3)
    for capacity in (16, 64):
        lengths = sorted(rng.integers(1, capacity + 1, 400).tolist(), reverse=True)
        rooms = []
        for n in lengths:
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                at = min(fit, key=lambda i: rooms[i])
                rooms[at] -= n
            else:
                rooms.append(capacity - n)
        runs, opened = bfd_packing.plan(Counter(lengths), capacity)
        assert opened == len(rooms)
        left, seen = [capacity] * opened, Counter()
        for length, first, n, window, room, each in runs:
            for k in range(n):
                assert left[window + k // each] == room - k % each * length
                left[window + k // each] -= length
            seen[length] += n
        assert seen == Counter(lengths) and min(left) >= 0
        assert sorted(left) == sorted(rooms)


def test_best_fit_packing(any_docs):
    texts = defaultdict(list)
    for r in any_docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    found = defaultdict(dict)
    total = 0
    for r in bfd_packing.pack(any_docs).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 2048 and not ids[r.n_tokens:].any()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        total += r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found[doc][start] = ids[a:b]
    assert total == sum(len(ids_of(t)) for ts in texts.values() for t in ts)
    for doc, ts in texts.items():
        if len(ts) == 1:
            assert np.array_equal(np.concatenate([found[doc][s] for s in sorted(found[doc])]), ids_of(ts[0]))


def test_best_fit_packing_with_repeats(spark):
    """Rows without id that are the same, more than a shard holds; every shard count packs the same ids tightly."""
    rows = [(None, "same words here")] * 300 + [(i, "w" * (i % 50)) for i in range(100)] + [(7, "a b c " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n_ids = sum(len(ids_of(t)) for _, t in rows)
    for shard_bytes in (1 << 12, 1 << 22):
        got = bfd_packing.pack(docs, shard_bytes=shard_bytes).collect()
        assert sum(r.n_tokens for r in got) == n_ids and len({r.sequence_id for r in got}) == len(got)
    assert len(got) <= -(-n_ids // 2048) + 1


# language model

def test_hidden_markov(any_docs):
    rows = any_docs.select("doc_id", "text").collect()
    tokens = [SPACE.findall(lower(r.text or "")) + ["\n"] for r in rows]
    counts = Counter()
    for r, t in zip(rows, tokens):
        if crc(r.doc_id, 5) not in (None, 1):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r, t in zip(rows, tokens):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[r.doc_id, crc(r.doc_id, 5) == 1, len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)] += 1
    got = hmm.score_documents(any_docs, warm_docs=50, passes=1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_forward_is_the_sum_over_paths():
    from itertools import product

    model = hmm.Model.begin(5, np.arange(5.0), states=3)
    seq = np.array([0, 3, 1, 4, 2, 2])
    want = 0.0
    for path in product(range(3), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[path[t], seq[t]]
        want += p
    got = hmm.log_likelihoods(model, np.concatenate([seq, seq[:2]]), np.array([6, 2]))
    assert abs(got[0] - math.log(want)) < 1e-9


def test_counts_raise_the_likelihood():
    rng = np.random.default_rng(4)
    classes, lengths = rng.integers(0, 20, 3000) // (1 + rng.integers(0, 3, 3000)), np.full(30, 100)
    prior = np.bincount(classes, minlength=20) / 3000 + 1e-3
    model, last = hmm.Model.begin(20, prior * 20, states=4), -np.inf
    for _ in range(5):
        now = hmm.log_likelihoods(model, classes, lengths).sum()
        assert now >= last - 30
        start, move, emit = hmm.expected_counts(model, classes, lengths, 20)
        assert abs(start.sum() - 30) < 1e-2 and abs(emit.sum() - 3000) < 0.5 and abs(move.sum() - 2970) < 0.5
        model, last = hmm.Model.of_counts(start, move, emit.T, prior), now


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m.group())] for k, p in BASE.items()}


def as_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in spans[k])


def test_personal_data(any_docs):
    want = Counter()
    for r in any_docs.select("doc_id", "text").collect():
        spans = base_spans(r.text)
        want[r.doc_id, *[len(spans[k]) for k in BASE], hashlib.sha256(as_text(spans).encode()).hexdigest(), as_text(spans)] += 1
    out = pii.find_personal_data(any_docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == Counter(
        {k: n for k, n in Counter([w[:-1] for w, n in want.items() for _ in range(n)]).items()})
    texts = {w[5]: w[6] for w in want}
    for r in out:
        assert set(filter(None, texts[r.base_sha256].split(","))) <= set(filter(None, r.spans.split(",")))


def test_personal_data_tricky(spark):
    texts = ["x@y.z_q@w.v a@b@c.de", "a@b.c.d. e@f", "1.2.3.4.5.6.7.8 0001.0.0.255 1.2.3.999", "+1 23 ( +123456789 +(12)",
             "4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111", "é😀 a@b.de +49 (30) 123-4567.", "9" * 20000,
             "1 " * 30000, "a" * 20000, "%+-@a.b", "+1" + "(" * 5000 + "2", "a.@b.c @d.e f@.g"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find_personal_data(rows, pii.Judge()).collect():
        assert r.spans == as_text(base_spans(texts[r.doc_id])), texts[r.doc_id][:50]
    clean = {r.doc_id: r.text for r in pii.redact(rows, pii.Judge()).collect()}
    assert clean[5] == "é😀 [EMAIL] [PHONE]."
    assert clean[8] == texts[8]


def test_trees_as_columns(spark, odd_docs):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [tuple(float(x) for x in rng.integers(0, 5, len(pii.FEATURES))) for _ in range(300)]
    df = spark.createDataFrame([(float(r[4] + r[5] > 4), r) for r in rows],
                               "label double, f struct<" + ",".join(f"{n}:double" for n in pii.FEATURES) + ">")
    df = df.withColumn("v", array_to_vector(F.array(*[F.col(f"f.{n}") for n in pii.FEATURES])))
    model = GBTClassifier(featuresCol="v", maxIter=3, maxDepth=3, seed=1).fit(df)
    judge = pii.Judge([pii.tree_of(t._java_obj.rootNode()) for t in model.trees], model.treeWeights)
    for r in model.transform(df).select("rawPrediction", judge.score(F.col("f")).alias("s")).collect():
        assert abs(r.rawPrediction[1] - r.s) < 1e-9


@pytest.mark.parametrize("run", [simhash.near_duplicates, simhash.keep_representatives, langid.keep_identified,
                                 curriculum.mix_report, curriculum.mixed_documents, retrieval_packing.pack_report,
                                 bfd_packing.pack, hmm.score_documents, pii.find_personal_data, pii.redact])
def test_empty_tables(odd_docs, run):
    assert run(odd_docs.where("doc_id = -1")).count() == 0


@pytest.mark.parametrize("run", [pii.find_personal_data, pii.redact])
def test_personal_data_learns_from_all_documents(spark, monkeypatch, run):
    from pyspark.sql import functions as F

    seen, save = [], pii.Scratch.save
    monkeypatch.setattr(pii.Scratch, "save", lambda self, *a: seen.append(save(self, *a)) or seen[-1])
    run(spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call 555-"), F.col("id") + 10_000_000).alias("text")))
    assert seen[0].count() == 30_000
