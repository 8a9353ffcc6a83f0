"""Best partners within reach without pairing everyone with everyone.

The score of a pair is a distance part, ``weight * max(0, 1 - d / reach)``, plus a quality part
that can be bounded per class of partners. Seekers first look up the nearest partners of their most
promising classes; the k-th best score found there is a bar. A class whose nearest partners all
reach its bound is settled: anyone further away scores less, anyone as near has a higher id. Any
other class can only add partners inside the radius its bound still pays for, so crowded places
lead to small radii, not to more pairs. Nothing is cut off: every partner that could be among the
best is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .nearest import nearest_on_globe
from .radius import radius_join
from .series import top_k_per_key

DIRECT_PAIRS = 50_000_000  # up to here comparing everyone is cheaper than looking for a bar
SEED_CLASSES = 6


@dataclass(frozen=True)
class Reach:
    """How seekers and partners meet.

    ``limit`` is the largest distance of a pair, a column of the side ``limit_side`` names.
    ``classes`` splits partners (the first one coarsely, all of them finely), ``summary`` describes a class by
    aggregates, ``bound`` turns a class summary into the largest quality a seeker can find there (null: none).
    ``relevant`` lists all partner columns the score depends on.
    """

    seeker_id: str
    partner_id: str
    seeker_at: tuple[str, str]
    partner_at: tuple[str, str]
    limit: Column
    limit_side: str
    score: Column
    weight: float
    reach_km: float
    classes: list[Column]
    summary: dict[str, Column]
    bound: Callable[[Column], Column]
    relevant: list[str]
    condition: Column | None = None
    floor: Column | None = None
    planar: bool = False


def best_in_reach(seekers: DataFrame, partners: DataFrame, plan: Reach, k: int, direct: bool | None = None) -> DataFrame:
    """Per seeker the ``k`` partners with the highest ``_score``; ties go to the lower partner id."""
    if direct is None:
        direct = seekers.count() * partners.count() <= DIRECT_PAIRS
    if direct:  # small tables may sit in one file: spread them before they multiply
        n = seekers.sparkSession.sparkContext.defaultParallelism
        pairs = _all_in_reach(seekers.repartition(n), partners.repartition(n), plan)
    else:
        pairs = _bounded(seekers, partners, plan, k)
    return top_k_per_key(pairs, [plan.seeker_id], [F.desc("_score"), F.asc(plan.partner_id)], k)


def _kept(pairs: DataFrame, plan: Reach) -> DataFrame:
    # through a generated column no later filter slips back into the join, with the distance written out each time it is named
    near = pairs.withColumn("distance_km", F.explode(F.array("distance_km"))).where(F.col("distance_km") <= plan.limit)
    if plan.condition is not None:
        near = near.where(plan.condition)
    return near.withColumn("_score", plan.score)


def _all_in_reach(seekers: DataFrame, partners: DataFrame, plan: Reach) -> DataFrame:
    if plan.limit_side == "seeker":
        pairs = radius_join(partners, seekers, plan.partner_at, plan.seeker_at, plan.limit, planar=plan.planar)
    else:
        pairs = radius_join(seekers, partners, plan.seeker_at, plan.partner_at, plan.limit, planar=plan.planar)
    return _kept(pairs, plan)


def _bounded(seekers: DataFrame, partners: DataFrame, plan: Reach, k: int) -> DataFrame:
    # equal partners differ by id only, so no more than the k lowest ids of each can be chosen
    copies = Window.partitionBy(*plan.relevant, *plan.partner_at).orderBy(plan.partner_id)
    names = [F.coalesce(c.cast("string"), F.lit("none")) for c in plan.classes]
    tagged = materialize(
        partners.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
        .withColumns({"_class": F.concat_ws("|", *names), "_branch": names[0]}), "partners")
    tree = materialize(_class_tree(tagged, plan), "partner-classes")
    tagged = tagged.drop("_branch")
    # a small file would be one task, and every seeker is to meet every class
    asking = materialize(seekers.repartition(seekers.sparkSession.sparkContext.defaultParallelism), "seekers")
    # the tree is one value, as many entries as there are classes, however many partners; it is never shuffled
    told = tree.scalar()

    def rated(classes: Column) -> Column:
        """Classes with something for the seeker, the most promising first."""
        made = F.transform(classes, lambda c: F.struct(
            (-plan.bound(c)).alias("rank"), c["_class"].alias("want"), c["_limit"].alias("cap")))
        return F.array_sort(F.filter(made, lambda c: c["rank"].isNotNull()))

    def leaves(branches: Column) -> Column:
        return rated(F.flatten(F.transform(branches, lambda b: b["leaves"])))

    cap = F.coalesce(F.col("_pick.cap"), plan.limit) if plan.limit_side == "seeker" else F.col("_pick.cap")
    hopeful = F.filter("_tree", lambda b: plan.bound(b).isNotNull())
    ranked = F.array_sort(F.transform(hopeful, lambda b: F.struct((-plan.bound(b)).alias("rank"), b["leaves"].alias("leaves"))))
    first = asking.withColumn("_tree", told).withColumn("_pick", F.explode(F.slice(leaves(F.slice(ranked, 1, SEED_CLASSES)), 1, SEED_CLASSES))).withColumns(
        {"_want": F.col("_pick.want"), "_cap": cap, "_best": -F.col("_pick.rank")}).drop("_pick", "_tree")
    first = materialize(first, "first-classes")  # rating classes costs more than reading a few rows per seeker
    spots = first.groupBy(*plan.seeker_at, "_want").agg(F.max("_cap").alias("_cap"))
    spots = spots.withColumnsRenamed({plan.seeker_at[0]: "_at0", plan.seeker_at[1]: "_at1", "_want": "_class_wanted"})
    found = nearest_on_globe(spots, tagged, ("_at0", "_at1"), plan.partner_at, plan.partner_id, k,
                             F.col("_cap"), same=(("_class_wanted", "_class"),), planar=plan.planar)
    found = found.drop("_cap", "_class").withColumnRenamed("_distance", "distance_km")
    # a seeker is several rows of ``first``, which Spark's sizes do not show: it may not be broadcast
    seeds = first.join(found.hint("merge"), [
        first[plan.seeker_at[0]] == found["_at0"], first[plan.seeker_at[1]] == found["_at1"],
        first["_want"] == found["_class_wanted"]]).drop("_at0", "_at1", "_class_wanted")
    fits = F.col("distance_km") <= plan.limit
    if plan.condition is not None:
        fits = fits & plan.condition
    seeds = materialize(seeds.withColumns({"_fits": F.coalesce(fits, F.lit(False)), "_score": plan.score}), "seeds")
    near_part = F.greatest(F.lit(0.0), 1 - F.col("distance_km") / plan.reach_km) * plan.weight
    perfect = F.col("_fits") & (F.col("distance_km") < plan.reach_km) & (
        F.col("_score") - near_part >= F.col("_best") - 1e-12)
    exhausted = (F.count("*") < k) | (F.max("distance_km") > F.max("_cap"))
    settled = seeds.groupBy(plan.seeker_id, "_want").agg(
        (exhausted | (F.count_if(perfect) == k)).alias("_settled")).where("_settled").drop("_settled")
    settled = materialize(settled, "settled-classes")
    certain = seeds.where("_fits").join(settled, [plan.seeker_id, "_want"], "left_semi")

    bars = seeds.where("_fits").groupBy(plan.seeker_id).agg(  # at most k x SEED_CLASSES scores
        F.get(F.sort_array(F.collect_list("_score"), False), F.lit(k - 1)).alias("_bar"))
    known = asking.join(bars, plan.seeker_id, "left")
    if plan.floor is not None:
        known = known.withColumn("_bar", F.greatest("_bar", plan.floor))
    known = known.withColumn("_tree", told)
    bar, best = F.col("_bar") - 1e-9, -F.col("_pick.rank")
    worth = F.filter("_tree", lambda b: bar.isNull() & plan.bound(b).isNotNull() | (plan.bound(b) + plan.weight >= bar))
    disks = known.withColumn("_pick", F.explode(leaves(worth))).where(bar.isNull() | (best + plan.weight >= bar))
    paid = F.when(bar > best, (1 - (bar - best) / plan.weight) * plan.reach_km + 1e-6)
    disks = disks.withColumns({"_want": F.col("_pick.want"), "_radius": F.least(cap, paid)}).drop("_pick", "_tree")
    disks = disks.where(F.col("_radius") >= 0).join(settled, [plan.seeker_id, "_want"], "left_anti")
    disks = materialize(disks, "disks")
    pairs = radius_join(tagged, disks, plan.partner_at, plan.seeker_at, F.col("_radius"),
                        extra_keys=(("_class", "_want"),), planar=plan.planar)
    scored = _kept(pairs.drop("_class", "_want", "_radius"), plan)
    scored = scored.where(F.col("_bar").isNull() | (F.col("_score") >= F.col("_bar") - 1e-9)).drop("_bar")
    return scored.unionByName(certain.select(*scored.columns))


def _class_tree(tagged: DataFrame, plan: Reach) -> DataFrame:
    """One row, one array: every branch (first class column) with its summary and the summaries of its leaves."""
    limit = F.max(plan.limit) if plan.limit_side == "partner" else F.lit(None).cast("double")
    aggs = [*[a.alias(n) for n, a in plan.summary.items()], limit.alias("_limit")]
    names = [*plan.summary, "_limit"]
    leaf = tagged.groupBy("_branch", "_class").agg(*aggs)
    lists = leaf.groupBy(F.col("_branch").alias("_of")).agg(F.collect_list(F.struct("_class", *names)).alias("leaves"))
    branch = tagged.groupBy("_branch").agg(*aggs).join(lists, F.col("_branch").eqNullSafe(F.col("_of")))
    return branch.agg(F.collect_list(F.struct(*names, "leaves")).alias("tree"))
