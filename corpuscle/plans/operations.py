"""Queries over operational data: events are job progress, orders an evaluation history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import scoring as S
from ..session import table

#: Weights of the stages of a job, in order; they sum to 100 (fixed values).
STAGES = (("signup", 15), ("view", 25), ("click", 30), ("purchase", 20), ("error", 10))
BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def _events(spark, sf):
    return table(spark, sf, "events")


def _history(spark, sf):
    """Evaluations: an order is a run, its priority the profile, its scaled price the score (null: not measurable)."""
    o = table(spark, sf, "orders")
    score = F.when(F.col("o_orderkey") % 17 != 0, F.round(F.col("o_totalprice") / 5000, 2))
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("package_id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("stage"), score.alias("score"), F.col("o_orderdate").alias("evaluated_at"))


def counter_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums by event type."""
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


def histogram_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative counts up to each bound, in long form, with the unbounded one."""
    e = _events(spark, sf)
    a = e.groupBy("event_type").agg(F.count("*").alias("inf"), *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)])
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return a.select("event_type", F.explode(pairs).alias("x")).select("event_type", "x.le", "x.n")


def success_rate_null(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases by finished attempts (purchases and errors) of each user; null where nothing finished."""
    ok, bad = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.try_divide(ok.cast("double"), ok + bad), 6).alias("success_rate"))


def stage_progress_running_max(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of each job after every event: it only rises, and only by events that are no errors."""
    done, upto = 0, F.lit(0)
    for name, weight in STAGES:
        done += weight
        upto = F.when(F.col("event_type") == name, done).otherwise(upto)
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rising = F.max(F.when(F.col("event_type") != "error", upto)).over(w)
    return _events(spark, sf).select("event_id", "user_id", F.coalesce(rising, F.lit(0)).cast("long").alias("progress"))


def replay_since_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Events after a cursor, in order within each job."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _events(spark, sf).where("event_id > 500").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("seq"), F.lag("event_type").over(w).alias("before"))


def oldest_claimable(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest order of each priority that is open and not leased (its lease, thirty days, ran out)."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").where(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") < F.lit("1998-06-01").cast("timestamp"))
    return o.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def suffix_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    """What a retry from the stage click clears: results of that stage and all later ones."""
    stages = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(STAGES)], "ord int, event_type string")
    e = _events(spark, sf).join(F.broadcast(stages), "event_type")  # five rows
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.bool_and(F.col("ord") >= 2).alias("cleared"))


def history_upsert_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    """The last evaluation of each package and profile, by time, then run."""
    h = _history(spark, sf).drop("stage")
    return S.last_wins(h, ["package_id", "profile"], ["evaluated_at", "run_id"]).select("package_id", "profile", "run_id", "score")


def benchmark_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of the scores of each profile and stage over all runs, those not measured left out."""
    d = S.distribution(_history(spark, sf), ["profile", "stage"], "score")
    return d.select("profile", "stage", "n", *[F.round(c, 4).alias(c) for c in ("median", "min", "max", "p25", "p75")], "sufficient")


def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The 90th percentile of event values by the nearest rank, half to even."""
    return S.nearest_rank(_events(spark, sf), ["event_type"], "value", 0.9, "p90")


def regression_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Each package's last score against the median of all runs of its profile, itself left out."""
    h = _history(spark, sf)
    current = S.last_wins(h.drop("stage"), ["package_id", "profile"], ["evaluated_at", "run_id"]).select("package_id", "profile", "run_id", "score")
    c = S.compare(current, h, ["profile"], "score")
    return c.select("package_id", "profile", F.round("delta", 4).alias("delta"), "change")


def trend_series(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest scores of each package, oldest first, with the change from the one before."""
    n = S.newest(_history(spark, sf).where("score is not null"), ["package_id"], "evaluated_at", "run_id", 5)
    w = Window.partitionBy("package_id").orderBy(F.col("rank").desc())
    return n.select("package_id", "run_id", "score", F.row_number().over(w).cast("long").alias("position"), F.round(F.col("score") - F.lag("score").over(w), 2).alias("change"))


def _metrics(spark, sf):
    """Metrics in long form: a line is a metric of its order's package; some cannot be measured."""
    i = table(spark, sf, "lineitem")
    score = F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity") * 2)
    return i.select(F.col("l_orderkey").alias("package_id"), F.col("l_returnflag").alias("stage"), score.alias("score"), (1 + F.col("l_linenumber") % 3).cast("double").alias("weight"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


def weighted_score_nullskip(spark: SparkSession, sf: str) -> DataFrame:
    """Stage scores: means by weight and confidence of what could be measured; null where nothing could."""
    s = S.stage_scores(_metrics(spark, sf), ["package_id", "stage"])
    return s.select("package_id", "stage", "n_metrics", "n_scored", F.round("score", 9).alias("score"))


def confidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Stage confidence: the mean of the scored metrics' times their share."""
    return S.stage_scores(_metrics(spark, sf), ["package_id", "stage"]).select("package_id", "stage", F.round("confidence", 9).alias("confidence"))


def overall_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Overall score of each package and its band."""
    o = S.overall(S.stage_scores(_metrics(spark, sf), ["package_id", "stage"]), ["package_id"])
    return o.select("package_id", F.round("overall", 9).alias("overall"), "n_stages", T.band_of(F.round("overall", 9), S.BANDS).alias("band"))


def band_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluations by band."""
    return _history(spark, sf).groupBy(T.band_of(F.col("score"), S.BANDS).alias("band")).agg(F.count("*").alias("n"))


def recommendations_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The five most pressing metrics of each package: by severity, score, stage."""
    m = _metrics(spark, sf).where("score is not null and score < 75").withColumn("severity", F.when(F.col("score") < 40, 0).when(F.col("score") < 60, 1).otherwise(2))
    w = Window.partitionBy("package_id").orderBy("severity", "score", "stage", "weight", "confidence")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("package_id", "stage", "score", F.col("severity").cast("long"), F.col("rank").cast("long"))


def error_class_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Messages by class: any of a class's marks in the text."""
    marks = {"limit": ["9}", "8}"], "capability": ["1}"]}
    e = _events(spark, sf).where("event_type = 'error'")
    has = {k: F.exists(F.array(*[F.lit(m) for m in ms]), lambda m: F.contains("props", m)) for k, ms in marks.items()}
    kind = F.when(has["limit"], "limit").when(has["capability"], "capability").otherwise("other")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def token_limit_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers read from messages: missing ones stay null, digits only, and cost at a price per million."""
    e = _events(spark, sf)
    used = T.digits_only(F.regexp_extract("props", '"k": (\\d+)', 1))
    return e.select("event_id", used.alias("used"), T.tolerant_int(F.get_json_object("props", "$.x"), -1).cast("long").alias("limit"), F.round(used * 0.15 / 1000, 6).alias("cost"))


def retry_delay_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from texts like 2m7.5s: minutes and seconds, either missing."""
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 == 0, F.format_string("%dm%s.5s", (F.col("event_id") % 4).cast("int"), (F.col("event_id") % 60).cast("string"))).when(F.col("event_id") % 3 == 1, F.format_string("%ds", (F.col("event_id") % 90).cast("int"))).otherwise("soon").alias("said"))
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract("said", p, 1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = F.when(F.col("said").rlike("[0-9](m|s)"), part("([0-9]+)m") * 60 + part("([0-9.]+)s"))
    return e.select("event_id", seconds.alias("seconds"))


def rates_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    """Packages by subject, by profile and in all, in one pass (grouping sets)."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("profile"))
    g = o.rollup("subject", "profile").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("subject", F.lit("(all)")).alias("subject"), F.coalesce("profile", F.lit("(all)")).alias("profile"), "n")


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extra: events by day and type."""
    g = _events(spark, sf).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Extra: events in windows of two hours that start every hour."""
    g = _events(spark, sf).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def events_session(spark: SparkSession, sf: str) -> DataFrame:
    """Extra: sessions of a user, ended by thirty hours without an event."""
    g = _events(spark, sf).groupBy("user_id", F.session_window("ts", "30 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Extra: two rankings of each label's vectors (by their first and second component) fused by reciprocal rank; the ten best."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    rank = lambda c: F.row_number().over(Window.partitionBy("label").orderBy(F.col(c).desc(), "vec_id"))
    both = e.select("label", "vec_id", rank("a").alias("r")).unionByName(e.select("label", "vec_id", rank("b").alias("r"))).where("r <= 200")
    s = both.groupBy("label", "vec_id").agg(F.sum(F.lit(1.0) / (60 + F.col("r"))).alias("s"))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.round("s", 9).desc(), "vec_id"))
    return s.withColumn("rank", best).where("rank <= 10").select("label", "vec_id", F.round("s", 6).alias("score"), F.col("rank").cast("long"))


_H = "h AS (SELECT o_orderkey AS run_id, o_custkey AS package_id, o_orderpriority AS profile, o_orderstatus AS stage, CASE WHEN o_orderkey % 17 <> 0 THEN round(o_totalprice / 5000, 2) END AS score, o_orderdate AS evaluated_at FROM orders)"
_M = "m AS (SELECT l_orderkey AS package_id, l_returnflag AS stage, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity * 2 END AS score, (1 + l_linenumber % 3)::DOUBLE AS weight, 1.0::DOUBLE - l_discount AS confidence FROM lineitem)"
_S = f"{_M}, s AS (SELECT package_id, stage, count(*) AS n_metrics, count(score) AS n_scored, sum(score * weight * confidence) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight * confidence END), 0) AS score, coalesce(avg(CASE WHEN score IS NOT NULL THEN confidence END) * count(score) / count(*), 0) AS confidence FROM m GROUP BY 1, 2)"
_UPTO = "CASE event_type WHEN 'signup' THEN 15 WHEN 'view' THEN 40 WHEN 'click' THEN 70 WHEN 'purchase' THEN 90 END"
_BAND = "CASE WHEN {0} >= 90 THEN 'exemplary' WHEN {0} >= 75 THEN 'strong' WHEN {0} >= 60 THEN 'adequate' WHEN {0} >= 40 THEN 'weak' WHEN {0} >= 0 THEN 'failing' END"
_RANK = "list_sort(list({0}))[CAST(round_even({1} * (count({0}) - 1), 0) AS BIGINT) + 1]"

ORACLES: dict[str, str] = {
    "counter_totals": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "histogram_buckets": "SELECT event_type, le, count(*) FILTER (value <= b) AS n FROM events, (VALUES " + ", ".join(f"('{b}', {b}::DOUBLE)" for b in BOUNDS) + ", ('+Inf', 1e308::DOUBLE)) t(le, b) GROUP BY 1, 2",
    "success_rate_null": "SELECT user_id, count(*) AS n, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 6) AS success_rate FROM events GROUP BY 1",
    "stage_progress_running_max": f"SELECT event_id, user_id, coalesce(max({_UPTO}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS progress FROM events",
    "replay_since_cursor": "SELECT event_id, user_id, row_number() OVER w AS seq, lag(event_type) OVER w AS before FROM events WHERE event_id > 500 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "oldest_claimable": "SELECT o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-06-01' GROUP BY 1",
    "suffix_invalidation": "SELECT event_type, count(*) AS n, event_type IN ('click', 'purchase', 'error') AS cleared FROM events GROUP BY 1",
    "history_upsert_lastwins": f"WITH {_H} SELECT package_id, profile, run_id, score FROM h QUALIFY row_number() OVER (PARTITION BY package_id, profile ORDER BY evaluated_at DESC, run_id DESC) = 1",
    "benchmark_distribution": f"WITH {_H} SELECT profile, stage, count(*) AS n, round(median(score), 4) AS median, round(min(score), 4) AS min, round(max(score), 4) AS max, round({_RANK.format('score', '0.25')}, 4) AS p25, round({_RANK.format('score', '0.75')}, 4) AS p75, count(*) >= 5 AS sufficient FROM h WHERE score IS NOT NULL GROUP BY 1, 2",
    "percentile_nearest_rank": f"SELECT event_type, {_RANK.format('value', '0.9')} AS p90 FROM events GROUP BY 1",
    "regression_compare": f"""WITH {_H}, c AS (SELECT package_id, profile, run_id, score FROM h QUALIFY row_number() OVER (PARTITION BY package_id, profile ORDER BY evaluated_at DESC, run_id DESC) = 1),
      d AS (SELECT c.run_id, count(*) AS n, median(k.score) AS m FROM c JOIN h k ON k.profile = c.profile AND k.run_id <> c.run_id GROUP BY 1)
      SELECT package_id, profile, round(score - m, 4) AS delta, CASE WHEN coalesce(n, 0) < 5 OR score IS NULL OR m IS NULL THEN 'unknown' WHEN score - m <= -5 THEN 'regressed' WHEN score - m >= 5 THEN 'improved' ELSE 'steady' END AS change FROM c LEFT JOIN d USING (run_id)""",
    "trend_series": f"""WITH {_H}, n AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY evaluated_at DESC, run_id DESC) AS rank FROM h WHERE score IS NOT NULL QUALIFY rank <= 5)
      SELECT package_id, run_id, score, row_number() OVER w AS position, round(score - lag(score) OVER w, 2) AS change FROM n WINDOW w AS (PARTITION BY package_id ORDER BY rank DESC)""",
    "weighted_score_nullskip": f"WITH {_S} SELECT package_id, stage, n_metrics, n_scored, round(score, 9) AS score FROM s",
    "confidence_coverage": f"WITH {_S} SELECT package_id, stage, round(confidence, 9) AS confidence FROM s",
    "overall_aggregate": f"""WITH {_S}, o AS (SELECT package_id, round(sum(score * greatest(confidence, 0.01::DOUBLE)) / nullif(sum(CASE WHEN score IS NOT NULL THEN greatest(confidence, 0.01::DOUBLE) END), 0), 9) AS overall, count(score) AS n_stages FROM s GROUP BY 1)
      SELECT package_id, overall, n_stages, {_BAND.format('overall')} AS band FROM o""",
    "band_ladder": f"WITH {_H} SELECT {_BAND.format('score')} AS band, count(*) AS n FROM h GROUP BY 1",
    "recommendations_sorted": f"""WITH {_M}, x AS (SELECT *, CASE WHEN score < 40 THEN 0 WHEN score < 60 THEN 1 ELSE 2 END::BIGINT AS severity FROM m WHERE score < 75)
      SELECT package_id, stage, score, severity, row_number() OVER (PARTITION BY package_id ORDER BY severity, score, stage, weight, confidence) AS rank FROM x QUALIFY rank <= 5""",
    "error_class_predicates": "SELECT CASE WHEN contains(props, '9}') OR contains(props, '8}') THEN 'limit' WHEN contains(props, '1}') THEN 'capability' ELSE 'other' END AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "token_limit_parse": """SELECT event_id, try_cast(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS used, -1::BIGINT AS "limit", round(try_cast(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) * 0.15::DOUBLE / 1000, 6) AS cost FROM events""",
    "retry_delay_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 4) * 60 + event_id % 60 + 0.5::DOUBLE WHEN 1 THEN (event_id % 90)::DOUBLE END AS seconds FROM events",
    "rates_by_subject": "SELECT coalesce(o_orderstatus, '(all)') AS subject, coalesce(o_orderpriority, '(all)') AS profile, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "events_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(i) AS s FROM events, (VALUES (0), (1)) v(i)) GROUP BY 1",
    "events_session": """WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 HOUR THEN 0 ELSE 1 END AS b, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
      c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
    "rrf_hybrid": """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings UNION ALL SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) FROM embeddings),
      s AS (SELECT label, vec_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM r WHERE r <= 200 GROUP BY 1, 2) SELECT label, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
}

QUERIES = {f.__name__: f for f in (
    counter_totals, histogram_buckets, success_rate_null, stage_progress_running_max, replay_since_cursor, oldest_claimable, suffix_invalidation, history_upsert_lastwins, benchmark_distribution,
    percentile_nearest_rank, regression_compare, trend_series, weighted_score_nullskip, confidence_coverage, overall_aggregate, band_ladder, recommendations_sorted, error_class_predicates,
    token_limit_parse, retry_delay_parse, rates_by_subject, events_tumbling, events_sliding, events_session, rrf_hybrid,
)}
