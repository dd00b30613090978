"""Scores that know what they could not measure, history and its regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch

BANDS = {"exemplary": 90.0, "strong": 75.0, "adequate": 60.0, "weak": 40.0, "failing": 0.0}
LEAST_HISTORY, TOLERANCE = 5, 5.0


def weighted(score: Column, weight: Column) -> Column:
    """Aggregate: the mean by weight of the scores there are; null without weight."""
    there = score.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(there, score * weight)), F.sum(F.when(there, weight)))


def covered_confidence(score: Column, confidence: Column) -> Column:
    """Aggregate: the mean confidence of the scored metrics times their share of all metrics; 0 if none is scored."""
    mean = F.avg(F.when(score.isNotNull(), confidence))
    return F.coalesce(mean * F.count(score) / F.count(F.lit(1)), F.lit(0.0))


def stage_scores(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Metrics (by, score, weight, confidence) to (by, n_metrics, n_scored, score, confidence)."""
    s, w, c = F.col("score"), F.col("weight"), F.col("confidence")
    return metrics.groupBy(*by).agg(F.count("*").alias("n_metrics"), F.count("score").alias("n_scored"), weighted(s, w * c).alias("score"), covered_confidence(s, c).alias("confidence"))


def overall(stages: DataFrame, by: list[str]) -> DataFrame:
    """Stage scores to one: each weighs by its confidence, 0.01 at least."""
    return stages.groupBy(*by).agg(weighted(F.col("score"), F.greatest("confidence", F.lit(0.01))).alias("overall"), F.count("score").alias("n_stages"))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order, by a partially aggregated maximum (no sort, no window)."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def _at(rows: DataFrame, by: list[str], value: str, places: dict) -> DataFrame:
    """(by, n, min, max, a column for each place): values at places(n) of the sorted values there are.

    Different values and their counts are dealt out in ranges of (by, value); running counts go over the
    ranges, then inside each, so that no task holds a group. Nothing is collected.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = scratch(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))  # the ranges depend on samples: dealt out once
    group = Window.partitionBy(*by)
    starts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_from"), before.alias("_start"), F.sum("_t").over(group).alias("_total"))
    same = F.col("_part") == F.col("_from")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    there = placed.withColumn("_upto", inside).join(starts, same).withColumn("_upto", F.col("_start") + F.col("_upto"))
    found = [F.min(F.when((F.col("_upto") - F.col("_n") <= place(F.col("_total"))) & (place(F.col("_total")) < F.col("_upto")), F.col("_v"))).alias(c) for c, place in places.items()]
    return there.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), *found)


def _rank(q: float):
    return lambda n: F.bround(q * (n - 1)).cast("long")


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """(by, name): the value at index round-half-even(q (n - 1)) of the sorted values; null for a group without values."""
    found = _at(rows, by, value, {name: _rank(q)}).select(*[F.col(c).alias(f"_by_{c}") for c in by], name)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.select(*by).distinct().join(found, same, "left").select(*by, name)


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, min, max, p25 and p75 (nearest rank) of the values there are; sufficient from five on."""
    middle = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)}
    d = _at(rows, by, value, {"p25": _rank(0.25), "p75": _rank(0.75), **middle})
    return d.select(*by, "n", (0.5 * F.col("_low") + 0.5 * F.col("_high")).alias("median"), "min", "max", "p25", "p75", (F.col("n") >= LEAST_HISTORY).alias("sufficient"))


def compare(current: DataFrame, history: DataFrame, by: list[str], value: str, most: int | None = None, order: str = "evaluated_at", tie: str = "run_id") -> DataFrame:
    """Current runs (by, tie, value) against the median of their group's runs (of the `most` newest, where given), themselves left out: delta and regressed, improved, steady or (fewer than five other runs) unknown.

    One value more or less is told by the values in the middle of a group, which are found by places over ranges of its values, so
    that every run is compared without itself in one pass and no group is gathered.
    """
    window = history if most is None else newest(history, by, order, tie, most)
    low, high = (lambda n: F.floor((n - 2) / 2)), (lambda n: F.ceil((n - 2) / 2))
    places = {
        "_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2),
        "_a": low, "_a1": lambda n: low(n) + 1, "_b": high, "_b1": lambda n: high(n) + 1,
    }
    middle = _at(window, by, value, places).select(*by, F.col("n").alias("_n"), (0.5 * F.col("_low") + 0.5 * F.col("_high")).alias("_whole"), "_a", "_a1", "_b", "_b1")
    held = window.groupBy(*by).agg(F.count("*").alias("_runs")).join(middle, by, "left")
    own = window.select(*by, tie, F.lit(True).alias("_own"))
    c = current.join(held, by, "left").join(own, [*by, tie], "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    without = lambda a, b: F.when(F.col(a) < F.col(value), F.col(a)).otherwise(F.col(b))
    median = F.when(F.col("_own") & F.col(value).isNotNull(), F.when(F.col("_n") > 1, 0.5 * without("_a", "_a1") + 0.5 * without("_b", "_b1"))).otherwise(F.col("_whole"))
    c = c.withColumn("median", median).withColumn("n", (F.coalesce("_runs", F.lit(0)) - F.col("_own").cast("int")).cast("long")).withColumn("delta", F.col(value) - F.col("median"))
    said = F.when((F.col("n") < LEAST_HISTORY) | F.col("delta").isNull(), "unknown").when(F.col("delta") <= -TOLERANCE, "regressed").when(F.col("delta") >= TOLERANCE, "improved").otherwise("steady")
    return c.withColumn("change", said).drop("_runs", "_n", "_whole", "_own", "_a", "_a1", "_b", "_b1")


def newest(rows: DataFrame, by: list[str], order: str, tie: str, most: int) -> DataFrame:
    """The `most` newest rows of each group, with their rank (a limit pushed before the shuffle by Spark)."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def history(rows: DataFrame, most: int, profile: str | None = None, subject: str | None = None, order: str = "evaluated_at", tie: str = "run_id") -> DataFrame:
    """The `most` newest evaluations, of one profile and subject where they are given."""
    for column, value in (("profile", profile), ("subject", subject)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(most)


def benchmark(rows: DataFrame, by: list[str], value: str, exclude: int | str | None = None, most: int = 1000, order: str = "evaluated_at", tie: str = "run_id") -> DataFrame:
    """distribution() over the `most` newest runs, without the one that is compared with it."""
    others = rows if exclude is None else rows.where(F.col(tie) != exclude)
    runs = others.select(tie, order).distinct().orderBy(F.col(order).desc(), F.col(tie).desc()).limit(most).select(tie)
    return distribution(others.join(runs, tie, "left_semi"), by, value)


def share(part: Column, whole: Column, empty: float | None = 1.0) -> Column:
    """part / whole; `empty` (null: not measurable) where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(empty).cast("double"))
