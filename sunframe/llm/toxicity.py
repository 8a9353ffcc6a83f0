"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posteriors.

1. A bounded sample of labelled rows gives a lexicon: words and word beginnings that toxic texts use far more often.
2. Voters are lists of that lexicon (by kind and by strength), how dense and how varied their hits are, and patterns of
   spelling. Each says toxic, clean or nothing about a text.
3. The label model has a hidden class per document. It is fitted to the vote patterns of all documents to learn
   from, counted by Spark, by expectation maximisation. A voter's accuracy depends on the class and on one other voter:
   the tree of the strongest correlations given the class, so that voters which repeat each other do not count
   twice. Votes of the labelled sample fix which class is the toxic one.
4. A logistic regression on words and word beginnings learns the posteriors of a bounded sample of documents, labelled or
   not, and scores every text.

Bounded parameters: ``LABELLED`` rows per class, ``TRAINED`` documents for the classifier, ``LEXICON`` and ``FEATURES``
terms. Vote patterns are counted over all rows whose id does not hold them out; their number is bounded by the voters.

Defined cases: a NULL or empty text has no terms, takes part as such and gets the score of a text without any; rows
without an id teach nothing and are not held out; ids whose labels disagree or are NULL are not labelled; repeated rows are
scored one by one; without labels of both classes every score is 0; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import Scratch, crc_mod

LABELLED = 8_000
TRAINED = 16_000
LEXICON = 1_500
FEATURES = 4_096
#: Documents of the sample that must use a term before it counts, and the lengths of word beginnings.
SUPPORT = 3
BEGINNINGS = range(3, 9)
#: A score from which a text is called toxic.
TOXIC = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
#: Patterns of spelling in a token that may go with abuse; the label model finds out whether they do.
PATTERNS = {
    "marks": re.compile(r"[!?]{2,}"),
    "starred": re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]"),
    "shouting": re.compile(r"\W*[^\W\d_a-zß-öø-ÿ]{3,}\W*\Z"),
    "stretched": re.compile(r"([^\W\d_])\1{3}"),
}
#: Tokens of a text that must show a pattern: one in so many, and this many at least.
SPELLED_SHARE, SPELLED = 20, 2
ABSTAIN, CLEAN, BAD = 0, 1, 2
#: Weight of the labelled sample's votes against those of all documents.
ANCHOR = 0.2
ROUNDS = 60
#: Ridge penalty of the classifier.
REGULAR = 0.0003


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [text.lower()] if text.isalpha() and text.isascii() else LETTERS.findall(text.lower())


class TermIndex:
    """Which of a set of terms a word has; beginnings are followed only as long as some term goes on that way."""

    def __init__(self, terms: dict):
        self.words = {t: v for t, v in terms.items() if not t.endswith("*")}
        self.starts = {t[:-1]: v for t, v in terms.items() if t.endswith("*")}
        self.paths = frozenset(t[:n] for t in self.starts for n in range(BEGINNINGS.start, len(t) + 1))

    def of(self, word: str) -> list:
        """The values of the terms, those of the word and of its beginnings."""
        out = [self.words[word]] if word in self.words else []
        for n in range(BEGINNINGS.start, min(len(word), BEGINNINGS.stop)):
            start = word[:n]
            if start not in self.paths:
                break
            if start in self.starts:
                out.append(self.starts[start])
        return out


class Remembered:
    """What a token means, worked out once and kept up to a bound; tokens without meaning are passed over."""

    def __init__(self, meaning, bound: int = 600_000):
        self.meaning, self.bound, self.met = meaning, bound, {}

    def of(self, tokens: Counter) -> list[tuple]:
        """(meaning, count) of the tokens that have one."""
        met, out = self.met, []
        for token, n in tokens.items():
            got = met.get(token)
            if got is None:
                if len(met) >= self.bound:
                    met.clear()
                got = met[token] = self.meaning(token) or ()
            if got:
                out.append((got, n))
        return out


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, marked with a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if n < len(word))]


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that models may learn from: those whose id does not hold them out."""
    return docs.where(crc_mod(F.col("doc_id"), 4) != 2)


def share_of(count: int, wanted: int) -> int:
    """Of a million hash values those to take, so that about ``wanted`` of ``count`` rows are."""
    return 1_000_000 if count <= wanted else int(wanted / count * 1_000_000) + 1


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``(doc_id, text, toxic)``: at most about ``most`` labelled ids of each class, chosen by a hash of the id."""
    agreed = (learnable(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")))
              .where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most"))
              .where("toxic = __most").drop("__most"))
    sizes = dict(agreed.groupBy("toxic").count().collect())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = agreed.where(F.when(F.col("toxic") == 1, place < share_of(sizes.get(1, 0), most))
                          .otherwise(place < share_of(sizes.get(0, 0), most)))
    # about 2 * most rows of two numbers, whatever the size of the tables
    return learnable(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, bad, good)``: weight of the distinct texts of each class that use a term; rows ``(text, p)``, p the share of toxic."""
    def scan(batches):
        counts: dict[str, list[float]] = {}
        for batch in batches:
            for text, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in {t for w in set(words_of(text)) for t in terms_of(w)}:
                    at = counts.get(term)
                    if at is None:
                        at = counts[term] = [0.0, 0.0]
                    at[0] += p
                    at[1] += 1 - p
                if len(counts) > 200_000:
                    yield flush(counts)
                    counts = {}
        yield flush(counts)

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([v[k] for v in counts.values()], pa.float64())
                                                                           for k in (0, 1))], names=["term", "bad", "good"])

    return (rows.select("text", "p").mapInArrow(scan, "term string, bad double, good double")
            .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))


def telling_terms(counts: DataFrame, bad: float, good: float, most: int, toxic_only: bool) -> list[tuple[str, float, float]]:
    """``(term, share of toxic texts, share of clean texts)`` of the terms whose shares differ most surely, best first."""
    p, q = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
    joint = (F.col("bad") + F.col("good") + 1) / (bad + good + 2)
    z = (p - q) / F.sqrt(joint * (1 - joint) * (1 / (bad + 1) + 1 / (good + 1)))
    enough = F.col("bad") >= SUPPORT if toxic_only else F.col("bad") + F.col("good") >= SUPPORT
    ranked = counts.where(enough).select("term", p.alias("p"), q.alias("q"), z.alias("z"))
    ranked = ranked.where("z > 3 and p > 3 * q") if toxic_only else ranked.withColumn("z", F.abs("z")).where("z > 3")
    return [(r.term, r.p, r.q) for r in ranked.orderBy(F.desc("z"), "term").limit(most).collect()]


def lexicon_lists(terms: list[tuple[str, float, float]]) -> dict[str, tuple[int, ...]]:
    """term -> numbers of the lists it is in: words, short, middle and long beginnings, each strong or weak."""
    out = {}
    for term, p, q in terms:
        length = len(term) - 1
        kind = 0 if not term.endswith("*") else 1 if length <= 4 else 2 if length <= 6 else 3
        out[term] = (kind * 2 + (0 if p > 20 * q else 1),)
    return out


N_LISTS = 8
VOTERS = [f"{kind} {band}" for kind in ("words", "short stems", "middle stems", "long stems") for band in ("strong", "weak")] + [
    "varied", "dense", "silent", *PATTERNS]


class Voters:
    """Votes of a text, from what its tokens (between white space) mean: words in lists, and patterns of spelling."""

    def __init__(self, lexicon: dict[str, tuple[int, ...]]):
        self.index, self.tokens = TermIndex(lexicon), Remembered(self.meaning)

    def meaning(self, token: str) -> tuple | None:
        words = tuple((w, found) for w in set(words_of(token))
                      if (found := tuple(sorted({n for lists in self.index.of(w) for n in lists}))))
        # a token of small letters alone can only be stretched
        plain = token.islower() and token.isalpha()
        shown = tuple(k for k, (name, p) in enumerate(PATTERNS.items()) if (not plain or name == "stretched") and p.search(token))
        return (words, shown) if words or shown else None

    def votes(self, text: str | None) -> list[int]:
        counts = Counter((text or "").split())
        total = max(1, sum(counts.values()))
        hits, spelled, words, strong = [0] * N_LISTS, [0] * len(PATTERNS), set(), 0
        for (listed, shown), n in self.tokens.of(counts):
            for word, lists in listed:
                words.add(word)
                for k in lists:
                    hits[k] += n
                    strong += n * (k % 2 == 0)
            for k in shown:
                spelled[k] += n
        out = []
        for k in range(N_LISTS):
            enough = hits[k] >= 1 if k % 2 == 0 else hits[k] >= max(2, total / 100)
            out.append(BAD if enough else ABSTAIN)
        out.append(BAD if len(words) >= 3 else CLEAN if not words else ABSTAIN)
        out.append(BAD if strong >= max(2, total / 50) else CLEAN if strong < total / 500 else ABSTAIN)
        out.append(CLEAN if not strong else ABSTAIN)
        return out + [BAD if n >= max(SPELLED, total / SPELLED_SHARE) else ABSTAIN for n in spelled]


def pattern_number(votes: list[int]) -> int:
    n = 0
    for v in votes:
        n = n * 3 + v
    return n


def patterns_of(numbers: np.ndarray, voters: int) -> np.ndarray:
    """The votes (rows) of pattern numbers."""
    return np.stack([numbers // 3 ** (voters - 1 - k) % 3 for k in range(voters)], axis=1)


def count_patterns(rows: DataFrame, lexicon) -> DataFrame:
    """``(pattern, bad, good, n)``: texts with each pattern of votes, and those of them labelled toxic or clean."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches):
        voters, counts = Voters(shared.value), {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = counts.setdefault(pattern_number(voters.votes(text)), [0, 0, 0])
                at[0] += toxic == 1
                at[1] += toxic == 0
                at[2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), *(pa.array([v[k] for v in counts.values()], pa.int64())
                                                                          for k in range(3))], names=["pattern", "bad", "good", "n"])

    return (rows.select("text", "toxic").mapInArrow(scan, "pattern long, bad long, good long, n long")
            .groupBy("pattern").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "n"))))


class LabelModel:
    """P(class) and, for every voter, P(vote | class, vote of its parent in the tree)."""

    def __init__(self, prior: float, parents: np.ndarray, tables: np.ndarray):
        self.prior, self.parents, self.tables = prior, parents, tables  # tables[voter, class, parent's vote, vote]

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for k, parent in enumerate(self.parents):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            out += np.log(self.tables[k][:, given, votes[:, k]]).T
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is toxic."""
        joint = self.log_joint(votes)
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -60, 60)))

    def accuracies(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each voter's votes that are not abstentions, the share the model thinks right."""
        p = self.posterior(votes)
        right = ((votes == BAD) * (n * p)[:, None] + (votes == CLEAN) * (n * (1 - p))[:, None]).sum(axis=0)
        return right / np.maximum(((votes != ABSTAIN) * n[:, None]).sum(axis=0), 1)


def correlations(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the class; ``weight[pattern, class]``."""
    m, total = votes.shape[1], weight.sum()
    hot = np.stack([votes == v for v in range(3)], axis=2).astype(np.float64)  # pattern, voter, vote
    info = np.zeros((m, m))
    for y in range(2):
        w = weight[:, y]
        mass = w.sum() + 1e-9
        pair = np.einsum("p,pav,pbw->avbw", w, hot, hot, optimize=True) / mass + 1e-9
        one = np.einsum("p,pav->av", w, hot) / mass + 1e-9
        info += mass / total * (pair * np.log(pair / (one[:, :, None, None] * one[None, None]))).sum(axis=(1, 3))
    np.fill_diagonal(info, 0)
    return np.maximum(info, 0)


def strongest_tree(info: np.ndarray) -> np.ndarray:
    """The parent of each voter in the spanning tree of largest total correlation; -1 for the first."""
    m = len(info)
    parents, inside = np.full(m, -1), [0]
    while len(inside) < m:
        outside = [k for k in range(m) if k not in inside]
        i, j = max(((i, j) for i in inside for j in outside), key=lambda e: (info[e], -e[1]))
        parents[j] = i
        inside.append(j)
    return parents


def estimate(votes: np.ndarray, weight: np.ndarray, parents: np.ndarray, smooth: float = 0.5) -> LabelModel:
    """The model of weighted patterns, ``weight[pattern, class]``."""
    m = votes.shape[1]
    tables = np.full((m, 2, 3, 3), smooth)
    for k, parent in enumerate(parents):
        given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
        for y in range(2):
            np.add.at(tables[k, y], (given, votes[:, k]), weight[:, y])
    # a parent's vote that was hardly ever seen takes the voter's share without a parent
    alone = tables.sum(axis=2, keepdims=True)
    tables = tables + 4 * alone / alone.sum(axis=3, keepdims=True)
    tables /= tables.sum(axis=3, keepdims=True)
    total = weight.sum(axis=0)
    return LabelModel(float(np.clip((total[1] + 1) / (total.sum() + 2), 1e-4, 1 - 1e-4)), parents, tables)


def fit_label_model(votes: np.ndarray, bad: np.ndarray, good: np.ndarray, n: np.ndarray, prior: float,
                    rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over all patterns (``n`` texts each); labelled ones start it and hold it in place."""
    share = np.array([1 - prior, prior])
    known = np.stack([good, bad], axis=1).astype(np.float64)
    known = known / np.maximum(known.sum(axis=0), 1) * share
    parents = strongest_tree(correlations(votes, known))
    model, before = estimate(votes, known * max(float((good + bad).sum()), 1), parents), None
    for step in range(rounds):
        p = model.posterior(votes)
        weight = np.stack([n * (1 - p), n * p], axis=1)
        if step == rounds // 4:  # the tree of what the hidden classes look like by now
            parents = strongest_tree(correlations(votes, weight))
        model = estimate(votes, weight + ANCHOR * n.sum() * known, parents)
        if before is not None and step > rounds // 4 and np.abs(p - before).max() < 1e-4:
            break
        before = p
    return model


class Features:
    """The features a text has, with their values."""

    def __init__(self, terms: dict[str, int]):
        self.index, self.tokens = TermIndex(terms), Remembered(self.meaning)

    def meaning(self, token: str) -> tuple[int, ...]:
        return tuple(k for w in words_of(token) for k in self.index.of(w))

    def of(self, text: str | None) -> dict[int, float]:
        sums: dict[int, int] = {}
        for features, n in self.tokens.of(Counter((text or "").split())):
            for k in features:
                sums[k] = sums.get(k, 0) + n
        return {k: float(np.log2(1 + n)) for k, n in sums.items()}


class Model:
    """Everything learned: the lexicon, the label model, what it thinks of the voters, the classifier."""

    def __init__(self, lexicon, label_model, accuracy, info, terms, weights, bias):
        self.lexicon, self.label_model, self.accuracy, self.info = lexicon, label_model, accuracy, info
        self.terms, self.weights, self.bias = terms, weights, bias

    def voters(self, spark) -> DataFrame:
        """``(voter, accuracy, correlated_with, information)``: the estimates of the label model."""
        rows = [(VOTERS[k], float(self.accuracy[k]), VOTERS[p] if p >= 0 else None, float(self.info[k, p]) if p >= 0 else None)
                for k, p in enumerate(self.label_model.parents.tolist())]
        return spark.createDataFrame(rows, "voter string, accuracy double, correlated_with string, information double")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, trained: int = TRAINED) -> Model | None:
    """The model; NULL without labels of both classes."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = scratch.save(labelled_sample(docs, labels, labelled), "sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    agreed = learnable(labels).where("toxic in (0, 1)").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if len(sizes) < 2:
        return None
    # copies of a text count once
    distinct = sample.groupBy("text").agg(F.avg(F.col("toxic").cast("double")).alias("p"))
    lexicon = lexicon_lists(telling_terms(term_counts(distinct), sizes[1], sizes[0], LEXICON, toxic_only=True))
    known = count_patterns(sample, lexicon)
    seen = count_patterns(learnable(docs).withColumn("toxic", F.lit(None).cast("int")), lexicon)
    counted = (seen.select("pattern", F.lit(0).alias("bad"), F.lit(0).alias("good"), "n")
               .union(known.select("pattern", "bad", "good", F.lit(0).alias("n")))
               .groupBy("pattern").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "n"))).orderBy("pattern").toPandas())
    votes = patterns_of(counted["pattern"].to_numpy(), len(VOTERS))
    bad, good, n = (counted[c].to_numpy().astype(np.float64) for c in ("bad", "good", "n"))
    label_model = fit_label_model(votes, bad, good, n, float(np.clip(agreed, 0.001, 0.999)))
    p = label_model.posterior(votes)
    info = correlations(votes, np.stack([n * (1 - p), n * p], axis=1))
    terms, weights, bias = fit_classifier(docs, lexicon, label_model, trained, scratch)
    return Model(lexicon, label_model, label_model.accuracies(votes, n), info, terms, weights, bias)


def fit_classifier(docs: DataFrame, lexicon, label_model: LabelModel, trained: int, scratch: Scratch):
    """Terms, their weights and the bias of a logistic regression on the posteriors of about ``trained`` documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lexicon, label_model))
    rows = learnable(docs)
    place = F.pmod(F.xxhash64("doc_id", F.lit("classifier")), F.lit(1_000_000))
    rows = rows.where(place < share_of(rows.count(), trained)).select("text")

    def judge(batches):
        voters = Voters(shared.value[0])
        for batch in batches:
            texts = batch.column(0).to_pylist()
            votes = np.array([voters.votes(t) for t in texts], dtype=np.int64).reshape(-1, len(VOTERS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value[1].posterior(votes))], names=["text", "p"])

    judged = scratch.save(rows.mapInArrow(judge, "text string, p double").groupBy("text").agg(
        F.first("p").alias("p"), F.count("*").alias("n")), "judged")
    bad, good = judged.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
    chosen = [t for t, *_ in telling_terms(term_counts(judged), bad, good, FEATURES, toxic_only=False)]
    terms = {t: k for k, t in enumerate(chosen)}
    if not terms:
        return terms, np.zeros(0), float(np.log(label_model.prior / (1 - label_model.prior)))
    given = spark.sparkContext.broadcast(terms)

    held = []

    @F.udf(returnType=VectorUDT())
    def vector(text):  # rows of the bounded sample only
        if not held:
            held.append(Features(given.value))
        return Vectors.sparse(len(given.value), held[0].of(text))

    # a posterior of p is a toxic example of weight p and a clean one of weight 1 - p
    examples = judged.withColumn("features", vector("text")).select(
        "features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
                                      F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x"))
    examples = scratch.save(examples.select("features", "x.label", "x.weight").where("weight > 0.001"), "examples")
    fitted = LogisticRegression(weightCol="weight", regParam=REGULAR, standardization=False, maxIter=80).fit(examples)
    return terms, fitted.coefficients.toArray(), float(fitted.intercept)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` of every row: the probability that its text is toxic."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return slim.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.bias))

    def scan(batches):
        terms, weights, bias = shared.value
        features = Features(terms)
        for batch in batches:
            sums = np.array([bias + sum(weights[k] * v for k, v in features.of(t).items())
                             for t in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -60, 60))))],
                                             names=["doc_id", "score"])

    return slim.mapInArrow(scan, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"))
