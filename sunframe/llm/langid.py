"""Language identification by words first, character n-grams for the rest.

A known word adds its log frequency in each language. An unseen word falls back to the longest character n-grams
of which at least one is known, and adds the mean of their log frequencies. The largest sum wins, ties go to the
language that sorts first.

The model is fitted on a bounded sample of the labelled rows (about ``sample_docs`` rows, chosen by a hash of the
id at a rate that follows from their number) and holds at most ``max_words`` words and ``max_grams`` n-grams, so
it can be broadcast at any corpus size. Predictions read whole texts of all rows and nothing but the text.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; without a single labelled row every
text is ``und``; NULL languages and ids do not teach; repeated rows are predicted one by one; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import Scratch, crc_mod, with_fields

UNKNOWN = "und"
SAMPLE_DOCS = 12_000
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
LONGEST_GRAM = 5
#: Words of one document that count in full when the score is made; more evidence does not sharpen it further.
EVIDENCE = 12
LETTERS = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    """Lower-case words of letters only, with their counts."""
    counts = Counter(LETTERS.findall(text.lower()))
    for odd in [w for w in counts if not w.isalpha()]:  # numerals that the pattern takes for letters
        n = counts.pop(odd)
        for part in "".join(c if c.isalpha() else " " for c in odd).split():
            counts[part] += n
    return counts


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its edges marked; shorter words have none beyond their length."""
    edged = f"<{word}>"
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def count_features(labelled: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """``(kind, gram, lang, n)``: words (kind 0) and n-grams (kind n), added up inside a task before the shuffle."""
    def scan(batches):
        words: dict[str, Counter] = defaultdict(Counter)

        def flush():
            rows = []
            for lang, counts in words.items():
                pieces: Counter = Counter()
                for word, n in counts.items():
                    rows.append((0, word, lang, n))
                    for size in range(1, longest + 1):
                        for g in grams(word, size):
                            pieces[size, g] += n
                rows.extend((size, g, lang, n) for (size, g), n in pieces.items())
            words.clear()
            for at in range(0, len(rows), 50_000):
                kind, gram, lang, n = zip(*rows[at:at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), pa.array(gram), pa.array(lang), pa.array(n, pa.int64())],
                    names=["kind", "gram", "lang", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(word_counts(text))
                if sum(map(len, words.values())) > 100_000:
                    yield from flush()
        yield from flush()

    return (labelled.select("lang", "text").mapInArrow(scan, "kind int, gram string, lang string, n long")
            .groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
        longest: int = LONGEST_GRAM, least: int = 2) -> dict:
    """The model: languages and, per known word or n-gram, a row of log frequencies."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & (crc_mod(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    n = labelled.select("lang", "doc_id").count()
    share = min(1.0, sample_docs / max(n, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    counted = count_features(chosen, longest)
    counted = Scratch(docs.sparkSession, "language").save(counted, "counts")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    per_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    ranked = counted.groupBy("kind", "gram").agg(F.sum("n").alias("total"), *per_lang).where(F.col("total") >= least)
    model = {"langs": langs, "longest": longest}
    for name, chosen, most in (("words", "kind = 0", max_words), ("grams", "kind > 0", max_grams)):
        got = ranked.where(chosen).orderBy(F.desc("total"), "kind", "gram").limit(most).toArrow()
        kinds = got.column("kind").to_numpy()
        table = np.stack([got.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float64) \
            if langs else np.zeros((0, 0))
        # smoothed over the mass of one kind, so that kinds and languages are comparable
        for kind in np.unique(kinds).tolist():
            own = kinds == kind
            table[own] = np.log((table[own] + 0.1) / (table[own].sum(axis=0) + 0.1 * own.sum()))
        model[name] = table.astype(np.float32)
        model[f"{name}_at"] = {gram: at for at, gram in enumerate(got.column("gram").to_pylist())}
    return model


class Scorer:
    """Applies a model; remembers the rows of words it has met, up to a bound."""

    def __init__(self, model: dict, remember: int = 100_000):
        self.langs, self.longest, self.remember, self.met = model["langs"], model["longest"], remember, {}
        self.words, self.words_at = model["words"], model["words_at"]
        self.grams, self.grams_at = model["grams"], model["grams_at"]

    def word(self, word: str) -> np.ndarray:
        at = self.words_at.get(word)
        if at is not None:
            return self.words[at]
        for n in range(self.longest, 0, -1):
            known = [i for g in grams(word, n) if (i := self.grams_at.get(g)) is not None]
            if known:
                return self.grams[known].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def text(self, text: str | None) -> tuple[str, float]:
        counts = word_counts(text) if text else None
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        met, rows = self.met, []
        for word in counts:
            row = met.get(word)
            if row is None:
                if len(met) >= self.remember:
                    met.clear()
                row = met[word] = self.word(word)
            rows.append(row)
        weights = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        sums = weights @ np.asarray(rows, dtype=np.float64)
        best = int(np.argmax(sums))
        gap = (sums - sums[best]) / weights.sum() * min(weights.sum(), EVIDENCE)
        return self.langs[best], float(1.0 / np.exp(gap).sum())


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score``; columns of these names are replaced."""
    model = fit(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score")
    place = base.columns.index("text")

    def scan(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.text(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(scan, with_fields(base, lang_pred="string", score="double"))


def predictions(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row."""
    slim = docs.select(F.col("doc_id").cast("long"), "lang", "text")
    return identify(slim.select("doc_id", "text"), fit(slim)).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Documents with a language: those that are ``und`` or undecided (score under ``least_score``) go."""
    named = identify(docs, fit(docs))
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(docs.columns)
