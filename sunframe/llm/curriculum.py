"""A mix of sources to target weights whose composition changes over training time.

Each source has a weight and a schedule: relative weights at equally spaced knots of training time 0..1, linear in
between. The integral of its schedule says which share of its target the source has delivered by any time; a
document's first token, counted in the source's own hashed order, is put through the inverse of that integral, and
the documents are range-sorted by the time found. A source whose target exceeds its size starts over.

Targets: weights by the place of the source's name in code-point order (NULL last), repeating; the wanted total is
shared by weight, a source gets at most ``max_passes`` times its size, and what is over goes to the others by
weight until none is above. A source's last document is cut where the target ends.

Only DataFrame expressions run. Sizes per source are combined before the shuffle; running sums use slices of about
sqrt(n) rows, so a source with a third of all rows makes no long window. Rows may carry texts or not.

Defined cases: NULL text has size 0; size-0 documents are never taken; a source of nothing else has target 0; a NULL source is a source; NULL or repeated
ids are rows of their own; an empty table gives an empty mix; columns that clash with results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import WORD, Scratch, dense_rank_mod, numbered_slices, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_PASSES = 2.0
#: Per place of the weight: heavy sources early, light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_targets(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_passes: float = MAX_PASSES) -> DataFrame:
    """One row per source: ``source, n_rows, source_size, place`` (of its weight) and ``target``."""
    sizes = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    ranked = dense_rank_mod(sizes, "source", scratch, "sources").withColumn("place", F.pmod("rank", F.lit(len(weights))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") + 1).cast("int"))
    table = scratch.save(ranked.drop("rank").withColumn("weight", weight), "weights")
    top = F.col("source_size") * max_passes
    wanted = (table.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = None
    while True:  # the level rises to where the sources below their limits take the rest; one row per pass
        full = F.lit(False) if level is None else top <= F.lit(level) * F.col("weight")
        fixed, open_weight = table.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            share = top
            break
        new = max((wanted - (fixed or 0.0)) / open_weight, level or 0.0)
        if level is not None and new <= level * (1 + 1e-12):
            share = F.least(top, F.lit(level) * F.col("weight"))
            break
        level = new
    return table.select("source", "n_rows", "source_size", "place", share.cast("double").alias("target"))


def demand_time(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source has delivered this share of its target: the schedule's integral, inverted."""
    chosen = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
        whole, done, time = sum(areas), 0.0, F.lit(1.0)
        cases = []
        for i, (a, b, area) in enumerate(zip(knots, knots[1:], areas)):
            left = share * whole - done
            root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) / step * left))
            inside = F.when(a + root > 0, 2 * left / (a + root)).otherwise(0.0)
            cases.append((share * whole < done + area, i * step + F.least(F.lit(step), inside)))
            done += area
        for condition, value in reversed(cases):
            time = F.when(condition, value).otherwise(time)
        chosen = F.when(place == number, time).otherwise(chosen)
    return chosen


def assign_positions(sized: DataFrame, scratch: Scratch, schedules=SCHEDULES, **mix) -> DataFrame:
    """Adds ``source_size, target, taken`` and ``copies``, an array of (taken, position), to rows with ``size``, ``h``.

    ``h`` is the order inside the source (:func:`unit_hash`).
    """
    targets = source_targets(sized, scratch, **mix)
    placed = numbered_slices(sized, "source", "h", F.col("size"), "__at", targets.select("source", "n_rows"))
    wide = (placed.join(targets.drop("n_rows").withColumnRenamed("source", "__source"),
                        F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"))
    end = F.round("target").cast("long")
    passes = int(-(-mix.get("max_passes", MAX_PASSES) // 1))
    copies = []
    for k in range(passes):
        start = F.col("__at") + F.lit(k) * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), end - start))
        # a source without words has target 0 and gives no copy
        position = demand_time(F.try_divide(start, F.col("target")), F.col("place"), schedules)
        copies.append(F.struct(taken.alias("taken"), position.alias("position")))
    return (wide.withColumn("copies", F.filter(F.array(*copies), lambda c: c.taken > 0))
            .withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c.taken))
            .drop("__at", "place"))


def sizes(docs: DataFrame, keep: list) -> DataFrame:
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, count.alias("size"), unit_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix_report(docs: DataFrame, **mix) -> DataFrame:
    """One row per document, in order of the first position: what the mix takes of it, and when."""
    scratch = Scratch(docs.sparkSession, "curriculum")
    sized = scratch.save(sizes(docs, ["doc_id", "source"]), "sizes")
    out = assign_positions(sized, scratch, **mix).select(
        F.col("doc_id").cast("long"), "size", "source_size", "target", "taken",
        F.get("copies", F.lit(0))["position"].alias("position"),
        F.get("copies", F.lit(1))["position"].alias("second_position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **mix) -> DataFrame:
    """The mix itself: one row per taken copy with the columns of ``docs``, sorted by position.

    The copy at which a source's target ends is cut there, and its ``n_chars`` (if there) follows.
    """
    scratch = Scratch(docs.sparkSession, "curriculum")
    names = [f"`{c}`" for c in docs.columns]
    sized = sizes(docs, [F.struct(*names).alias("doc"), "source"])
    copies = assign_positions(sized, scratch, **mix).select("doc", "size", F.explode("copies").alias("copy"))
    cut = F.col("copy.taken") < F.col("size")
    text = F.when(cut, first_words(F.col("doc.text"), F.col("copy.taken"))).otherwise(F.col("doc.text"))
    put = {"text": text}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(cut, F.length(text).cast("long")).otherwise(F.col("doc.n_chars").cast("long"))
    return copies.orderBy("copy.position", "doc.doc_id").select(
        *[put.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
