import numpy as np
import pytest
from pyspark.sql import functions as F

from sunframe.llm import toxicity
from sunframe.llm.tools import crc_mod


@pytest.fixture(scope="module")
def table(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark, table):
    docs, labels = table
    got = toxicity.toxicity_report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    held = [r for r in rows if r.held_out]
    caught = np.mean([r.predicted for r in held if r.toxic == 1])
    wrong = np.mean([r.predicted for r in held if r.toxic == 0])
    assert caught >= 0.9 and wrong <= 0.01, (caught, wrong)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_are_never_used(spark, table):
    """Turning over every held-out label, and languages and sources, changes no score."""
    docs, labels = (t.where("doc_id < 700") for t in table)
    held = crc_mod(F.col("doc_id"), 4) == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    a, b = (dict((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity_report(*x).collect()) for x in ((docs, labels), (turned, other)))
    assert a == b


def brute_posterior(model, votes):
    """P(toxic | votes) by walking the tree voter by voter."""
    joint = [1 - model.prior, model.prior]
    for y in (0, 1):
        for k, v in enumerate(votes):
            parent = model.parents[k]
            joint[y] *= model.tables[k, y, votes[parent] if parent >= 0 else 0, v]
    return joint[1] / sum(joint)


def test_label_model_finds_accuracies_and_copies():
    """Voters of known accuracy, one of them copied twice: the copies hang together and do not outvote the others."""
    rng = np.random.default_rng(2)
    y = (rng.random(20_000) < 0.3).astype(int)
    right = [0.9, 0.8, 0.75, 0.7]
    votes = np.stack([np.where(rng.random(len(y)) < a, y, 1 - y) + 1 for a in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    copies = votes[:, 3:4].repeat(2, axis=1)
    votes = np.concatenate([votes, copies], axis=1)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    n = np.bincount(at).astype(float)
    few = np.zeros(len(y), dtype=bool)
    few[:200] = True
    bad, good = (np.bincount(at[few & (y == c)], minlength=len(n)).astype(float) for c in (1, 0))
    model = toxicity.fit_label_model(patterns, bad, good, n, 0.3)
    for row in patterns[:50]:
        assert abs(brute_posterior(model, row) - model.posterior(row[None])[0]) < 1e-9
    edges = {frozenset(e) for e in enumerate(model.parents.tolist()) if e[1] >= 0}
    assert len({3, 4, 5} & set().union(*[e for e in edges if e <= {3, 4, 5}])) == 3  # the copies form one part of the tree
    found = model.accuracies(patterns, n)
    assert np.abs(found[:4] - right).max() < 0.05, found
    said = model.posterior(patterns)[at] >= 0.5
    independent = np.log([a / (1 - a) for a in [*right, 0.7, 0.7]])
    naive = ((votes == 2) - (votes == 1).astype(int)) @ independent + np.log(0.3 / 0.7) > 0
    assert np.mean(said == y) > np.mean(naive == y)


def test_pattern_numbers():
    rows = np.array([[0, 1, 2, 2], [2, 0, 0, 1]])
    numbers = np.array([toxicity.pattern_number(r) for r in rows.tolist()])
    assert (toxicity.patterns_of(numbers, 4) == rows).all()


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "x") for i in range(60)] + [(100, 1, None, "x"), (101, 1, 1, "x"),
                                   (101, 1, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, lang string")
    got = toxicity.toxicity_report(odd_docs, labels)
    assert got.count() == odd_docs.count()
    assert got.where("score is null or held_out is null or predicted is null").count() == 0
    assert got.where("doc_id is null and held_out").count() == 0
    nobody = toxicity.toxicity_report(odd_docs, labels.where("toxic = 0"))
    assert nobody.where("score <> 0").count() == 0 and nobody.count() == odd_docs.count()
    assert toxicity.toxicity_report(odd_docs.limit(0), labels.limit(0)).count() == 0


def test_term_index_equals_looking_up_every_term():
    rng = np.random.default_rng(2)

    def word():
        return "".join(rng.choice(list("abc"), rng.integers(1, 12)))

    for _ in range(60):
        words = [word() for _ in range(50)]
        terms = {t: i for i, t in enumerate(sorted({t for w in words[:20] for t in toxicity.terms_of(w)[::2]}))}
        index = toxicity.TermIndex(terms)
        for w in words:
            assert sorted(index.of(w)) == sorted(terms[t] for t in toxicity.terms_of(w) if t in terms)


def test_spelling_of_tokens():
    voters = toxicity.Voters({"idiot": (0,), "idi*": (2,)})
    for token in ["idiot!!", "IDIOT", "ab*cd", "sooooo", "plain", "Été", "a1b", "x", "LOUD,", "ß!"]:
        want = tuple(k for k, p in enumerate(toxicity.PATTERNS.values()) if p.search(token))
        assert (voters.meaning(token) or ((), ()))[1] == want
