"""Planning arithmetic: period counts, contiguous bands, minutes, item kinds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

from ..functions.lexicon import capped_bloom

#: Teaching load by importance, minutes a core concept takes, bounds (fixed values of the planning rules).
LOADS, DEFAULT_LOAD, CORE_MINUTES, MOST_PERIODS = {"core": 1.0, "supporting": 0.5, "enrichment": 0.25}, 0.5, 12.0, 20
MARKS, DEFAULT_MARKS = {"mcq": 1, "short_answer": 3, "numerical": 4, "long_answer": 6}, 2
ARC = (("entry", 0.12), ("instruction", 0.28), ("practice", 0.30), ("checkpoint", 0.15), ("exit", 0.15))


def load_of(importance: Column) -> Column:
    out = F.lit(DEFAULT_LOAD)
    for name, load in LOADS.items():
        out = F.when(importance == name, load).otherwise(out)
    return out


def period_count(load: Column, minutes: Column, concepts: Column) -> Column:
    """Periods for a load: what one holds divides it, at least 1, at most 20 and one per concept."""
    need = F.ceil(load / (F.greatest(minutes, F.lit(1)) / CORE_MINUTES))
    return F.greatest(F.lit(1), F.least(need, F.lit(MOST_PERIODS), F.greatest(concepts, F.lit(1)))).cast("long")


def item_budget(concepts: Column, objectives: Column) -> Column:
    return F.greatest(F.lit(6), F.least(2 * concepts + objectives, F.lit(24))).cast("long")


def cut_points(loads: np.ndarray, count: int) -> list[int]:
    """Starts of `count` contiguous bands whose heaviest is as light as can be; of equal cuts the earliest."""
    n = len(loads)
    count = max(1, min(count, n))
    total = np.concatenate([[0.0], np.cumsum(loads)])
    best, cuts = total.copy(), []
    for k in range(2, count + 1):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for i in range(k, n + 1):
            heavy = np.maximum(best[k - 1 : i], total[i] - total[k - 1 : i])
            at = int(heavy.argmin())
            nxt[i], cut[i] = heavy[at], k - 1 + at
        best = nxt
        cuts.append(cut)
    starts, end = [], n
    for cut in reversed(cuts):
        end = int(cut[end])
        starts.append(end)
    return [0, *reversed(starts)]


def bands(ordered: DataFrame) -> DataFrame:
    """(package_id, position, load, count) with the `band` (from 0) of each position.

    The dynamic program needs a package's few concepts together; it runs once per package on
    a list of their loads.
    """

    @F.pandas_udf("array<int>")
    def starts(loads: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([cut_points(np.asarray(x, dtype=float), int(c)) for x, c in zip(loads, count, strict=True)])

    lists = F.array_sort(F.collect_list(F.struct("position", "load")))
    rows = ordered.groupBy("package_id").agg(lists.alias("rows"), F.max("count").alias("count"))
    rows = rows.withColumn("starts", starts(F.transform("rows", lambda r: r["load"]), "count"))
    out = rows.select("package_id", "starts", F.posexplode("rows").alias("i", "r"))
    return out.select("package_id", "r.position", "r.load", (F.size(F.filter("starts", lambda s: s <= F.col("i"))) - 1).alias("band"))


def apportion(shares: DataFrame, group: list[str], order: list[str], weight: str = "weight", total: str = "total") -> DataFrame:
    """Adds `part`: whole parts of `total` in proportion to the weights by largest remainder, ties in order."""
    w = Window.partitionBy(*group)
    exact = F.coalesce(F.try_divide(F.col(weight) * F.col(total), F.sum(weight).over(w)), F.lit(0.0))
    s = shares.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    s = s.withColumn("_left", F.col(total) - F.sum("_floor").over(w))
    rank = F.row_number().over(w.orderBy((F.col("_exact") - F.col("_floor")).desc(), *order))
    return s.withColumn("part", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_exact", "_floor", "_left")


def whole_minutes(raw: np.ndarray, duration: int) -> np.ndarray:
    """Minutes of a period's slots as whole numbers of at least 1 that add up to its duration (or to one each, if it is shorter).

    What rounding down leaves goes to the largest remainders, round after round; what the minimum of 1
    takes too much comes off the largest slots, one minute at a time, the earliest of equals first.
    """
    n = len(raw)
    low = np.maximum(np.floor(raw).astype(np.int64), 1)
    missing = max(duration, n) - int(low.sum())
    if missing > 0:
        order = np.lexsort((np.arange(n), -(raw - np.floor(raw))))
        low += missing // n
        low[order[: missing % n]] += 1
    for _ in range(-missing):
        at = int(low.argmax())
        if low[at] <= 1:
            break
        low[at] -= 1
    return low


def time_slots(periods: DataFrame, minutes: str = "minutes", duration: str = "duration") -> DataFrame:
    """Adds `slots`: the whole minutes of each period's slots (an array of numbers, those not above 0 left out) scaled to its duration.

    A period with more slots than minutes keeps the longest in their order; one without any gets the default arc.
    """
    arc = [share for _, share in ARC]

    @F.pandas_udf("array<int>")
    def fitted(wanted: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for w, t in zip(wanted, total, strict=True):
            t = int(t)
            x = np.array([v for v in (w if w is not None else []) if v is not None and v > 0], dtype=float)
            if len(x) > t:
                x = x[np.lexsort((np.arange(len(x)), -x))[:t]]
            x = x if len(x) else np.array(arc)
            out.append(whole_minutes(x * t / x.sum(), t).tolist())
        return pd.Series(out)

    return periods.withColumn("slots", fitted(F.col(minutes).cast("array<double>"), duration))


def objective_bands(objectives: DataFrame, bands: DataFrame, names: DataFrame) -> DataFrame:
    """(package_id, band, objective_id): each objective in the band where the last of its concepts is taught.

    objectives (package_id, objective_id, concept_ids, tokens of the statement), bands (package_id, concept_id, band), names
    (package_id, concept_id, tokens of the name). An objective without a taught concept goes to that of the concept
    whose name shares most words with it, the later band of equals; without any, nowhere. A band that gets none
    borrows the first objective of the nearest band that has one, the earlier of equals.
    """
    own = objectives.select("package_id", "objective_id", F.explode("concept_ids").alias("concept_id")).join(bands, ["package_id", "concept_id"]).groupBy("package_id", "objective_id").agg(F.max("band").alias("band"))
    lost = objectives.join(own, ["package_id", "objective_id"], "left_anti").select("package_id", "objective_id", F.explode(F.array_distinct("tokens")).alias("word"))
    words = names.join(bands, ["package_id", "concept_id"]).select("package_id", "concept_id", "band", F.explode(F.array_distinct("tokens")).alias("word"))
    shared = lost.join(words, ["package_id", "word"]).groupBy("package_id", "objective_id", "concept_id", "band").agg(F.count("*").alias("n"))
    placed = own.unionByName(shared.groupBy("package_id", "objective_id").agg(F.max_by("band", F.struct("n", "band")).alias("band")))
    first = placed.groupBy("package_id", "band").agg(F.min("objective_id").alias("objective_id"))
    empty = bands.select("package_id", "band").distinct().join(first, ["package_id", "band"], "left_anti").withColumnRenamed("band", "to_band")
    near = empty.join(first, "package_id").groupBy("package_id", "to_band").agg(F.min_by("objective_id", F.struct(F.abs(F.col("band") - F.col("to_band")), "band")).alias("objective_id"))
    return placed.select("package_id", "band", "objective_id").unionByName(near.select("package_id", F.col("to_band").alias("band"), "objective_id"))


SECOND_FROM_CONCEPTS, LEAST_ACTIVITY, MOST_SHARE = 3, 8, 0.45


def activity_minutes(slots: Column, duration: Column, n: Column) -> Column:
    """Minutes of each of a period's n activities: the longest of its middle slots (without those, 45 % of it), shared, 8 at least and 45 % at most."""
    middle = F.array_max(F.slice(slots, F.lit(2), F.greatest(F.size(slots) - 2, F.lit(0))))
    longest = F.when(F.size(slots) >= 3, F.coalesce(middle, F.lit(0))).otherwise(F.bround(duration * MOST_SHARE)).cast("int")
    ceiling = F.greatest(F.lit(LEAST_ACTIVITY), F.floor(duration * MOST_SHARE))
    return F.greatest(F.lit(LEAST_ACTIVITY), F.least(F.floor(longest / n), ceiling)).cast("int")


def activity_slots(periods: DataFrame, pool: list[str]) -> DataFrame:
    """(package_id, period_no, activity_id, type, minutes): one activity a period (package_id, period_no, n_concepts, slots, duration), two where three concepts or more and 16 minutes allow.

    Types take turns over the package in the order of the pool.
    """
    one = F.lit(1)
    two = (F.col("n_concepts") >= SECOND_FROM_CONCEPTS) & (activity_minutes(F.col("slots"), F.col("duration"), one) >= 2 * LEAST_ACTIVITY)
    p = periods.withColumn("n", F.when(two, 2).otherwise(1)).withColumn("minutes", activity_minutes(F.col("slots"), F.col("duration"), F.col("n")))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    turn = F.row_number().over(Window.partitionBy("package_id").orderBy("period_no", "k")) - 1
    names = F.array(*[F.lit(x) for x in pool])
    return p.select("package_id", "period_no", F.format_string("act_p%d_%d", F.col("period_no").cast("int"), "k").alias("activity_id"), F.get(names, (turn % len(pool)).cast("int")).alias("type"), "minutes")


def blended(mix: Column, emphasis: Column) -> Column:
    """A mix of kinds (map to shares) multiplied by a board's emphasis (1 where it names none) and made to add up to 1; the mix itself if nothing is left."""
    scaled = F.map_zip_with(mix, F.map_filter(emphasis, lambda k, _: F.map_contains_key(mix, k)), lambda _, a, b: a * F.coalesce(b, F.lit(1.0)))
    total = F.aggregate(F.map_values(scaled), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform_values(scaled, lambda _, x: x / total)).otherwise(mix)


def kind_plan(packages: DataFrame) -> DataFrame:
    """(package_id, position, kind): a package's item kinds in turns, from (package_id, budget, mix): shares of the budget rounded half to even; without any, all short answers."""
    counts = packages.select("package_id", "budget", F.explode_outer("mix").alias("kind", "share")).withColumn("count", F.bround(F.col("budget") * F.coalesce("share", F.lit(0.0))).cast("int"))
    some = counts.where("count > 0").select("package_id", "kind", "count")
    none = packages.select("package_id", F.lit("short_answer").alias("kind"), F.greatest("budget", F.lit(1)).cast("int").alias("count")).join(some.select("package_id").distinct(), "package_id", "left_anti")
    return round_robin(some.unionByName(none), ["package_id"]).select("package_id", "position", "kind")


def coverage_targets(objectives: DataFrame, concepts: DataFrame) -> DataFrame:
    """(package_id, position, objective_id, concept_ids, bloom): what items should cover, in order: every objective, then every concept that no objective names."""
    ids = objectives.select("package_id", "ord", "objective_id", "bloom", F.explode_outer("concept_ids").alias("concept_id")).join(concepts.select("package_id", "concept_id", F.lit(True).alias("there")), ["package_id", "concept_id"], "left")
    own = ids.groupBy("package_id", "ord", "objective_id", "bloom").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.col("concept_id")))).alias("concept_ids"))
    rest = concepts.join(ids.where("there").select("package_id", "concept_id").distinct(), ["package_id", "concept_id"], "left_anti")
    own = own.select("package_id", F.lit(0).alias("part"), "ord", F.col("objective_id"), "concept_ids", F.coalesce("bloom", F.lit("understand")).alias("bloom"))
    rest = rest.select("package_id", F.lit(1).alias("part"), "ord", F.lit(None).cast(own.schema["objective_id"].dataType).alias("objective_id"), F.array("concept_id").alias("concept_ids"), F.lit("understand").alias("bloom"))
    rank = F.row_number().over(Window.partitionBy("package_id").orderBy("part", "ord", "objective_id", "concept_ids"))
    return own.unionByName(rest).withColumn("position", rank).drop("part", "ord")


def blueprint(plan: DataFrame, targets: DataFrame, scale: float = 1.0) -> DataFrame:
    """(package_id, item_id, kind, marks, bloom, objective_id, concept_ids): the items of a plan over the targets in turn; multiple choice asks for application at most."""
    n = targets.groupBy("package_id").agg(F.max("position").alias("n"))
    p = plan.join(n, "package_id").withColumn("at", (F.col("position") - 1) % F.col("n") + 1)
    j = p.join(targets.withColumnRenamed("position", "at"), ["package_id", "at"])
    level = F.when(F.col("kind") == "mcq", capped_bloom(F.col("bloom"))).otherwise(F.col("bloom"))
    return j.select("package_id", F.format_string("item_%02d", F.col("position").cast("int")).alias("item_id"), "kind", marks_of(F.col("kind"), F.lit(scale)).alias("marks"), level.alias("bloom"), "objective_id", "concept_ids")


def rebuilt_options(options: Column) -> Column:
    """The options (text, is_correct, why) of a multiple-choice item without blank texts and, whatever the case, repetitions, of which the first stays; correct if a repetition is. Null unless two are left and one is correct."""
    said = F.transform(options, lambda o: F.struct(F.trim(o["text"]).alias("text"), F.lower(F.trim(o["text"])).alias("key"), F.coalesce(o["is_correct"], F.lit(False)).alias("right"), o["why"].alias("why")))
    first = lambda k: F.filter(k, lambda x, i: ~F.exists(F.slice(k, F.lit(1), i), lambda y: y["key"] == x["key"]))
    right = lambda k, x: F.exists(k, lambda y: (y["key"] == x["key"]) & y["right"])
    told = lambda k: F.transform(first(k), lambda x: F.struct(x["text"].alias("text"), right(k, x).alias("is_correct"), x["why"].alias("why")))
    sound = lambda o: F.when((F.size(o) >= 2) & (F.size(F.filter(o, lambda x: x["is_correct"])) == 1), o)
    return T.let(T.let(F.filter(said, lambda o: F.coalesce(o["text"], F.lit("")) != ""), told), sound)


def rubric_ladder(marks: Column) -> Column:
    """The levels of a fallback rubric from the top down, as shares of the marks: four from six marks on, three from three, else two."""
    at = lambda *shares: F.transform(F.array(*[F.lit(s) for s in shares]), lambda s: F.bround(marks * s).cast("int"))
    return F.when(marks >= 6, at(1.0, 0.75, 0.5, 0.25)).when(marks >= 3, at(1.0, 0.6, 0.3)).otherwise(at(1.0, 0.5))


def script_windows(segments: DataFrame, most: int = 10) -> DataFrame:
    """(package_id, period_no, ord, start, stop): a period's segments (minutes, duration) laid one after another over its duration; those after the first `most` are left out."""
    w = Window.partitionBy("package_id", "period_no")
    s = segments.withColumn("k", F.row_number().over(w.orderBy("ord"))).where(F.col("k") <= most).withColumn("minutes", F.greatest(F.coalesce("minutes", F.lit(0)), F.lit(0)))
    upto = F.sum("minutes").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("upto", upto).withColumn("all", F.sum("minutes").over(w)).where("all > 0")
    at = lambda c: F.bround(c * F.col("duration") / F.col("all")).cast("int")
    return s.select("package_id", "period_no", "ord", at(F.col("upto") - F.col("minutes")).alias("start"), at(F.col("upto")).alias("stop"))


def round_robin(counts: DataFrame, group: list[str], kind: str = "kind", count: str = "count") -> DataFrame:
    """One row per item: kinds take turns, the most frequent first, ties by name; adds `turn` and `position`."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(count).desc(), kind))
    items = counts.where(F.col(count) > 0).withColumn("_rank", rank).withColumn("turn", F.explode(F.expr(f"sequence(1, int({count}))")))
    position = F.row_number().over(Window.partitionBy(*group).orderBy("turn", "_rank"))
    return items.withColumn("position", position).drop("_rank")


def marks_of(kind: Column, scale: Column) -> Column:
    """Marks by kind and the board's scale, rounded half to even, 1 at least."""
    base = F.lit(DEFAULT_MARKS)
    for name, marks in MARKS.items():
        base = F.when(kind == name, marks).otherwise(base)
    return F.greatest(F.bround(base * scale).cast("long"), F.lit(1).cast("long"))
