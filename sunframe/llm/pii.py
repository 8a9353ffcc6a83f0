"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

Base detectors (fixed patterns with checks) always count. Looser generators propose more spans, which may overlap
them: numbers with any separators, mail addresses with spaces or words for their signs. Features of a proposal's
format and of its surroundings go through gradient-boosted trees, trained on one half of the proposals of all documents, in
which those that a base detector confirms are the positive ones; each kind's threshold is the lowest score at which the
other, held-out half keeps the wanted precision. A proposal at or above it that overlaps no base span is
added.

The main path is DataFrame expressions alone: matches and the gaps between them give positions in code points
(``regexp_extract_all`` and ``split`` see the same matches), and the trees become CASE expressions over the
proposals of a row, so nothing is exploded, joined or shuffled while texts are read. Patterns are possessive and
start at the edge of a run, so they take linear time and no deep stack on long runs.

Defined cases: a NULL or empty text has no spans and the hash of the empty string; repeated rows and NULL ids return
a row each; without proposals of both outcomes nothing is added to the base; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import Scratch

#: Fixed: the kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Fixed: the same matches as the contract's patterns; possessive, and not begun inside a run that just failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall proposals.
PROPOSE = {
    "mail": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)"
            r"[A-Za-z0-9-]++(?:(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9])\+?+\(?+[0-9](?:[\x20().:/-]{0,2}+[0-9])++",
}
PRECISION = 0.99
ROUNDS = 12
DEPTH = 4
NUMBER_SHAPE = 7
WINDOW = 24
CONTEXT_WORDS = {
    "mail_word": "(?i)(?:mail|contact|write|courriel|correo|kontakt)[^a-z]*+$",
    "phone_word": "(?i)(?:phone|call|tel|fax|mobile|dial|telefon)[^a-z]*+$",
    "card_word": "(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)[^a-z]*+$",
    "ip_word": "(?i)(?:ip|host|server|address|login)[^a-z]*+$",
}


def matches(text: Column, pattern: str, valid=lambda m: F.lit(True)) -> Column:
    """array<struct<s, e, m>> of the valid ones among the leftmost non-overlapping matches: start, end (exclusive), text.

    Others only move the position on, so a text of a million bare numbers grows no array.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    step = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x.g) + F.length(x.m)).cast("long").alias("at"),
            F.when(valid(x.m), F.concat(acc.out, F.array(F.struct(
                (acc.at + F.length(x.g)).cast("long").alias("s"),
                (acc.at + F.length(x.g) + F.length(x.m)).cast("long").alias("e"), x.m.alias("m")))))
            .otherwise(acc.out).alias("out")),
        lambda acc: acc.out)
    return F.when(F.size(found) > 0, step).otherwise(empty)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid_ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m, r"\."), small)


def valid_card(m: Column) -> Column:
    return F.length(digits_of(m)).between(13, 19) & F.call_function("luhn_check", digits_of(m))


def valid_phone(m: Column) -> Column:
    return F.length(digits_of(m)).between(9, 15)


VALID = {"email": lambda m: F.lit(True), "ip": valid_ip, "card": valid_card, "phone": valid_phone}
#: What a text must contain before a pattern is tried.
SIGN = {"email": "@", "ip": None, "card": None, "phone": "+"}
NONE = "array<struct<s:bigint,e:bigint,m:string>>"


def base_columns(text: Column) -> dict[str, Column]:
    """The base detectors: kind -> array<struct<s, e, m>>."""
    out = {}
    for kind in KINDS:
        needed = F.contains(text, F.lit(SIGN[kind])) if SIGN[kind] else text.rlike("[0-9]")
        spans = matches(text, BASE[kind], VALID[kind])
        out[kind] = F.when(needed, spans).otherwise(F.array().cast(NONE))
    return out


def holds_proposal(text: Column) -> Column:
    mail = F.lit(False)
    for sign in ("@", "(at)", "[at]", " dot ", " at "):
        mail = mail | F.contains(text, F.lit(sign))
    return mail


def proposal_columns(text: Column) -> dict[str, Column]:
    mail = F.when(holds_proposal(text), matches(text, PROPOSE["mail"])).otherwise(F.array().cast(NONE))
    number = F.when(text.rlike("[0-9]"), matches(
        text, PROPOSE["number"], lambda m: F.length(digits_of(m)) >= NUMBER_SHAPE)
    ).otherwise(F.array().cast(NONE))
    return {"mail": mail, "number": number}


def kind_of(source: str, m: Column) -> Column:
    if source == "mail":
        return F.lit("email")
    return (F.when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
            .when(F.length(digits_of(m)) >= 13, "card").otherwise("phone"))


FEATURES = ["is_mail", "is_ip", "is_card", "is_phone", "length", "digits", "signs", "spaces", "dots", "dashes",
            "brackets", "groups", "first_group", "last_group", "small_parts", "check_digit", "literal_at",
            "left_letter", "right_letter", "left_sign", *CONTEXT_WORDS]


def feature_struct(text: Column, x: Column, source: str) -> Column:
    """Format and context of one proposal, as doubles."""
    m, kind = x.m, kind_of(source, x.m)
    before = text.substr(F.greatest(x.s - WINDOW + 1, F.lit(1)).cast("int"), F.least(x.s, F.lit(WINDOW)).cast("int"))
    after = text.substr((x.e + 1).cast("int"), F.lit(1))
    digits = F.length(digits_of(m))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda p: F.size(F.split(m, p, -1)) - 1
    numbers = F.regexp_extract_all(m, F.lit("([0-9]+)"), F.lit(1))
    values = {
        "is_mail": flag(kind == "email"), "is_ip": flag(kind == "ip"), "is_card": flag(kind == "card"),
        "is_phone": flag(kind == "phone"), "length": x.e - x.s, "digits": digits,
        "signs": F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")), "spaces": count("\\x20"), "dots": count("\\."),
        "dashes": count("-"), "brackets": count("[()\\[\\]]"), "groups": F.size(numbers),
        "first_group": F.length(F.coalesce(F.get(numbers, F.lit(0)), F.lit(""))),
        "last_group": F.length(F.coalesce(F.element_at(F.when(F.size(numbers) > 0, numbers), -1), F.lit(""))),
        "small_parts": flag(valid_ip(m) & (kind == "ip")),
        "check_digit": flag((kind == "card") & F.when(digits.between(13, 19), F.call_function("luhn_check", digits_of(m)))),
        "literal_at": flag(F.contains(m, F.lit("@"))),
        "left_letter": flag(before.rlike("[\\p{L}_]$")), "right_letter": flag(after.rlike("^[\\p{L}_]")),
        "left_sign": flag(before.rlike("[=:\"/.#-]$")),
        **{name: flag(before.rlike(p)) for name, p in CONTEXT_WORDS.items()},
    }
    return F.struct(*[F.coalesce(values[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (x.s < b.e) & (b.s < x.e))


def all_base(names=KINDS) -> Column:
    return F.concat(*[F.col(f"__{k}") for k in names])


def with_spans(docs: DataFrame, keep: list) -> DataFrame:
    """``__text``, one array column per kind (``__email`` ...), and the proposals that are no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("__text"))
    df = df.select("*", *[c.alias(f"__{k}") for k, c in base_columns(F.col("__text")).items()])
    return df.select("*", *[c.alias(f"__p_{k}") for k, c in proposal_columns(F.col("__text")).items()])


def judged(text: Column, source: str, array: Column) -> Column:
    """array<struct<s, e, m, kind, f>> of the proposals of one generator."""
    return F.transform(array, lambda x: F.struct(
        x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), kind_of(source, x.m).alias("kind"),
        feature_struct(text, x, source).alias("f")))


def training_rows(docs: DataFrame) -> DataFrame:
    """Proposals of all documents that hold any: ``kind, label, half, f``."""
    spans = with_spans(docs.where(F.col("text").rlike("[0-9]") | holds_proposal(F.col("text"))), [])
    every = F.concat(*[judged(F.col("__text"), s, F.col(f"__p_{s}")) for s in PROPOSE])
    return (spans.select(F.explode(every).alias("x"), F.array_compact(all_base()).alias("base"))
            .select("x.kind", "x.f", F.pmod(F.xxhash64("x.m", "x.s"), F.lit(2)).alias("half"),
                    overlaps(F.col("x"), F.col("base")).cast("double").alias("label")))


def tree_of(node):
    """A fitted regression tree as nested (feature, threshold, left, right), leaves as numbers."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), tree_of(node.leftChild()), tree_of(node.rightChild())


def tree_column(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, limit, left, right = tree
    return F.when(f[name] <= limit, tree_column(left, f)).otherwise(tree_column(right, f))


class Judge:
    """Trained trees with their weights, and the score each kind must reach."""

    def __init__(self, trees=(), weights=(), thresholds=None):
        self.trees, self.weights, self.thresholds = list(trees), list(weights), dict(thresholds or {})

    def score(self, f: Column) -> Column:
        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + F.lit(weight) * tree_column(tree, f)
        return total

    def accepts(self, x: Column) -> Column:
        limit = F.lit(None).cast("double")
        for name, value in self.thresholds.items():
            limit = F.when(x.kind == name, F.lit(value)).otherwise(limit)
        return F.coalesce(self.score(x.f) >= limit, F.lit(False))


def train(docs: DataFrame, precision: float = PRECISION, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 7) -> Judge:
    """Boosted trees on one half of all proposals, thresholds from the other half."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(training_rows(docs), "proposals")
    seen = {r[0] for r in rows.where("half = 0").select("label").distinct().collect()}
    if len(seen) < 2:
        return Judge()
    vector = array_to_vector(F.array(*[F.col(f"f.{n}") for n in FEATURES]))
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed).fit(
        rows.where("half = 0").select("label", vector.alias("v")))
    judge = Judge([tree_of(t._java_obj.rootNode()) for t in model.trees], [float(w) for w in model.treeWeights])
    step = 0.05
    bins = (rows.where("half = 1").select("kind", "label", F.floor(judge.score(F.col("f")) / step).alias("bin"))
            .groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect())
    for kind in KINDS:
        n = good = 0.0
        for row in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            n, good = n + row["n"], good + row["good"]
            if good >= precision * n:
                judge.thresholds[kind] = row["bin"] * step
    return judge


def span_text(spans: Column) -> Column:
    """kind:start:end, by kind and then start, comma-joined; spans are structs (k, s, e)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def numbered(kind: str, array: Column) -> Column:
    number = KINDS.index(kind)
    return F.transform(array, lambda x: F.struct(F.lit(number).alias("k"), x.s.alias("s"), x.e.alias("e")))


def detect(docs: DataFrame, judge: Judge | None = None, keep: list | None = None) -> DataFrame:
    """The kept columns, ``__text``, ``__base`` and ``__spans``: arrays of (k, s, e), k the kind's number."""
    judge = train(docs) if judge is None else judge
    df = with_spans(docs, keep or [])
    base = F.concat(*[numbered(k, F.col(f"__{k}")) for k in KINDS])
    df = df.select("*", base.alias("__base"))
    added = []
    for source in PROPOSE:
        fresh = F.filter(F.col(f"__p_{source}"), lambda x: ~overlaps(x, F.col("__base")))
        taken = F.filter(judged(F.col("__text"), source, fresh), judge.accepts)
        number = lambda x: sum((F.when(x.kind == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
        added.append(F.transform(taken, lambda x: F.struct(number(x).alias("k"), x.s.alias("s"), x.e.alias("e"))))
    df = df.select("*", added[0].alias("__mail"), added[1].alias("__number"))
    numbers = F.filter("__number", lambda x: ~overlaps(x, F.col("__mail")))
    return df.select("*", F.concat("__base", "__mail", numbers).alias("__spans"))


def find_personal_data(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """One row per document: base counts, the hash of the base spans, and all spans as text."""
    out = detect(docs, judge, [F.col("doc_id").cast("long").alias("doc_id")])
    return out.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(span_text(F.col("__base")), 256).alias("base_sha256"),
                      span_text(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ``n_chars`` (if there) follows the new text.

    Overlapping spans are replaced as one, under the kind of the first.
    """
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__doc"), "text")
    out = detect(packed, train(docs) if judge is None else judge, ["__doc"])
    none = F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")
    by_start = F.array_sort(F.transform("__spans", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"))))
    merged = F.aggregate(by_start, none, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.struct(x.k, x.s, x.e))), F.greatest(F.size(acc), F.lit(1))).e > x.s),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.transform(F.slice(acc, F.greatest(F.size(acc), F.lit(1)), 1), lambda y: F.struct(
            y.k.alias("k"), y.s.alias("s"), F.greatest(y.e, x.e).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"))))))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    out = out.select("__doc", "__text", merged.alias("__cut"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cut", lambda x: x.e))
    pieces = F.transform("__cut", lambda x, i: F.concat(
        F.col("__text").substr((F.get(ends, i) + 1).cast("int"), (x.s - F.get(ends, i)).cast("int")), F.get(tags, x.k)))
    tail = F.col("__text").substr((F.element_at(ends, -1) + 1).cast("int"), F.length("__text"))
    clean = F.when(F.size("__cut") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("__doc.text"))
    out = out.select("__doc", clean.alias("__clean"), (F.size("__cut") > 0).alias("__changed"))
    put = {"text": F.col("__clean")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("__changed"), F.length("__clean").cast("long")).otherwise(F.col("__doc.n_chars").cast("long"))
    return out.select(*[put.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
