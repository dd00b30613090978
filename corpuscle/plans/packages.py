"""Queries over packages: orders are packages, their lines items, parts concepts, suppliers periods.

Every operator takes all packages at once. Ids that a rule is to find dangling come from a filter
on the parts that a package knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import allocation as A
from ..operators import graphs
from ..operators import scoring as S
from ..session import scratch as _scratch
from ..session import table


def _items(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "mcq").when(F.col("l_returnflag") == "N", "short_answer").otherwise("long_answer")
    level = F.when(F.col("l_quantity") < 10, "remember").when(F.col("l_quantity") < 20, "understand").when(F.col("l_quantity") < 30, "apply").when(F.col("l_quantity") < 40, "analyze").otherwise("evaluate")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("concept_id"), F.col("l_suppkey").alias("period"),
        kind.alias("kind"), level.alias("bloom"), F.col("l_quantity").cast("long").alias("marks"), F.col("l_linestatus").alias("status"),
    )


def _concepts(spark, sf, known: bool = False):
    """All parts as concepts; known: without every tenth, so that references to them dangle."""
    importance = F.when(F.col("p_size") >= 35, "core").when(F.col("p_size") >= 15, "supporting").otherwise("enrichment")
    return table(spark, sf, "part").where("p_partkey % 10 <> 3" if known else "true").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), importance.alias("importance"), "p_size")


def anti_untaught(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts that no finished item of 45 marks or more names."""
    items = _items(spark, sf).where("status = 'F' and marks >= 45")
    return _concepts(spark, sf).join(items.select("concept_id").distinct(), "concept_id", "left_anti").select("concept_id", "name")


def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References from items to concepts that do not exist, by package."""
    return _items(spark, sf).join(_concepts(spark, sf, known=True).select("concept_id"), "concept_id", "left_anti").groupBy("package_id").agg(F.count("*").alias("n_dangling"), F.min("concept_id").alias("first_concept"))


def semi_objective_assessed(spark: SparkSession, sf: str) -> DataFrame:
    """Packages some finished item of which names a core concept: array overlap as a semi-join."""
    core = _concepts(spark, sf).where("importance = 'core'").select("concept_id")
    finished = _items(spark, sf).where("status = 'F'").join(core, "concept_id", "left_semi").select("package_id").distinct()
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "package_id")
    return o.join(finished, "package_id", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n_packages"))


def prereq_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive items of a package whose concept is scheduled in an earlier period than its predecessor's (the first period of a concept counts)."""
    items = _items(spark, sf)
    period = items.groupBy("package_id", "concept_id").agg(F.min_by("period", F.struct("ord", "period")).alias("p"))
    w = Window.partitionBy("package_id").orderBy("ord", "concept_id", "period")
    edges = items.select("package_id", F.col("concept_id").alias("to_id"), F.lag("concept_id").over(w).alias("from_id")).where("from_id is not null and from_id <> to_id").distinct()
    a = period.select("package_id", F.col("concept_id").alias("from_id"), F.col("p").alias("p_from"))
    b = period.select("package_id", F.col("concept_id").alias("to_id"), F.col("p").alias("p_to"))
    return edges.join(a, ["package_id", "from_id"]).join(b, ["package_id", "to_id"]).groupBy("package_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("p_from") > F.col("p_to")).alias("n_violations"))


def dup_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Concept names that several concepts share, compared without case."""
    c = _concepts(spark, sf)
    return c.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("concept_id").alias("first_id"), F.max("concept_id").alias("last_id")).where("n > 1")


def dedup_merge_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts merged by name: the first one's fields win, evidence is joined in order."""
    c = _concepts(spark, sf)
    g = c.groupBy("name").agg(F.min_by("importance", "concept_id").alias("importance"), F.array_sort(F.collect_list(F.struct("concept_id", "p_size"))).alias("rows"))
    return g.select("name", "importance", F.array_join(F.transform("rows", lambda r: r["p_size"].cast("string")), ",").alias("evidence"))


def timing_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Periods whose minutes do not add up to what the package's board expects, by package."""
    items = _items(spark, sf).groupBy("package_id", "period").agg(F.sum("marks").alias("minutes"))
    return items.groupBy("package_id").agg(F.count("*").alias("n_periods"), F.count_if(F.col("minutes") != 40).alias("n_mismatched"), F.max(F.abs(F.col("minutes") - 40)).alias("worst"))


def default_lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by board: an exact lookup, without regard to case and blanks, and the generic one where it fails."""
    boards = spark.sql("SELECT * FROM VALUES ('building', 45), ('machinery', 40), ('generic', 50) AS t(board, minutes)")
    c = table(spark, sf, "customer").select(F.lower(F.trim("c_mktsegment")).alias("board"))
    j = c.join(F.broadcast(boards), "board", "left")  # three rows
    generic = boards.where("board = 'generic'").select(F.col("minutes").alias("other"))
    found = F.coalesce("minutes", F.lit(generic.scalar()))
    return j.groupBy(found.cast("long").alias("minutes")).agg(F.count("*").alias("n"))


def blueprint_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What each package's items realise: by kind, by level, marks by package."""
    i = _items(spark, sf)
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("mcq", "short_answer", "long_answer")]
    return i.groupBy("package_id").agg(*kinds, F.count_distinct("bloom").alias("n_levels"), F.sum("marks").alias("total_marks"))


def blueprint_full_outer_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Claimed against actual counts by kind: a full outer join, absent sides 0."""
    i = _items(spark, sf)
    actual = i.groupBy("period", "kind").agg(F.count("*").alias("actual"))
    claimed = i.where("status = 'F' or ord = 1").groupBy("period", "kind").agg(F.count("*").alias("claimed")).where("claimed > 2")
    j = actual.join(claimed, ["period", "kind"], "full_outer")
    return j.select("period", "kind", F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("claimed", F.lit(0)).alias("claimed"), F.abs(F.coalesce("actual", F.lit(0)) - F.coalesce("claimed", F.lit(0))).alias("drift"))


def marks_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose marks differ from their kind's, by kind (marks scaled by 1.5, rounded half to even)."""
    i = _items(spark, sf).withColumn("expected", A.marks_of(F.col("kind"), F.lit(1.5)))
    return i.groupBy("kind", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("marks") != F.col("expected")).alias("n_off"))


def bloom_mark_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a package status's marks by level, and whether it reaches 5 %."""
    i = _items(spark, sf).groupBy("status", "bloom").agg(F.sum("marks").alias("marks"))
    part = S.share(F.col("marks"), F.sum("marks").over(Window.partitionBy("status")))
    return i.select("status", "bloom", F.round(part, 6).alias("share"), (part >= 0.05).alias("counts"))


def kind_mix_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the absolute differences between a package's mix of kinds and the intended one."""
    want = {"mcq": 0.4, "short_answer": 0.35, "long_answer": 0.25}
    n = F.count("*")
    drift = sum((F.abs(F.count_if(F.col("kind") == k) / n - w) for k, w in want.items()), F.lit(0.0))
    return _items(spark, sf).groupBy("package_id").agg(F.round(drift, 6).alias("drift"))


def coverage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """By package: share of concepts taught, assessed and marked; what has nothing to check has weight 0."""
    i = _items(spark, sf).join(_concepts(spark, sf).select("concept_id", "importance"), "concept_id", "left")
    core = F.col("importance") == "core"
    a = i.groupBy("package_id").agg(F.count("*").alias("n"), F.count("importance").alias("known"), F.count_if(F.col("importance").isNotNull() & (F.col("status") == "F")).alias("assessed"), F.count_if(core).alias("n_core"), F.count_if(core & (F.col("marks") >= 10)).alias("core_marked"))
    m = a.select("package_id", S.share(F.col("known"), F.col("n")).alias("taught"), S.share(F.col("assessed"), F.col("known")).alias("assessed"), S.share(F.col("core_marked"), F.nullif("n_core", F.lit(0))).alias("core_marked"), F.when(F.col("n_core") > 0, 0.06).otherwise(0.0).alias("core_weight"))
    score = (m.taught * 0.16 + m.assessed * 0.16 + m.core_marked * m.core_weight) / (F.lit(0.32) + m.core_weight)
    return m.select("package_id", F.round("taught", 6).alias("taught"), F.round("assessed", 6).alias("assessed"), F.round("core_marked", 6).alias("core_marked"), F.round(score * 100, 4).alias("score"))


def sequencing_load_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalance of a package's periods: (largest - smallest) / mean load."""
    p = _items(spark, sf).groupBy("package_id", "period").agg(F.sum("marks").alias("load"))
    return p.groupBy("package_id").agg(F.count("*").alias("n_periods"), F.round(F.try_divide((F.max("load") - F.min("load")).cast("double"), F.avg("load")), 6).alias("imbalance"))


def adjacent_rubric_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Share of adjacent lines of a package that differ in level: fewer than two lines give 0."""
    w = Window.partitionBy("package_id").orderBy("ord", "concept_id", "period", "bloom")
    i = _items(spark, sf).withColumn("before", F.lag("bloom").over(w))
    return i.groupBy("package_id").agg(F.round(S.share(F.count_if(F.col("bloom") != F.col("before")), F.count("before"), 0.0), 6).alias("differing"))


def distinct_terms_once(spark: SparkSession, sf: str) -> DataFrame:
    """Words of concept names that stand in exactly one brand: what tells brands apart."""
    words = table(spark, sf, "part").select("p_brand", F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))), "\\s+")).alias("term")).where("length(term) >= 2").distinct()
    return words.groupBy("term").agg(F.count("*").alias("n"), F.min("p_brand").alias("brand")).where("n = 1").select("term", "brand")


def period_count(spark: SparkSession, sf: str) -> DataFrame:
    """Periods that each package's concepts need, and the size of its item bank."""
    i = _items(spark, sf).join(_concepts(spark, sf).select("concept_id", "importance"), "concept_id", "left").groupBy("package_id").agg(F.count("*").alias("n"), F.sum(A.load_of(F.col("importance"))).alias("load"))
    return i.select("package_id", A.period_count(F.col("load"), F.lit(20), F.col("n")).alias("periods"), A.item_budget(F.col("n"), F.floor(F.col("n") / 2)).alias("items"))


def band_partition_dp(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous bands of each package's items whose heaviest is as light as can be (three at most)."""
    i = _items(spark, sf).select("package_id", F.col("ord").alias("position"), F.col("marks").cast("double").alias("load"), F.lit(3).alias("count"))
    b = A.bands(i)
    return b.groupBy("package_id", "band").agg(F.count("*").alias("n"), F.sum("load").cast("long").alias("load")).select("package_id", F.col("band").cast("long"), "n", "load")


def apportion_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty minutes of each package shared out by marks, by largest remainder."""
    i = _items(spark, sf).select("package_id", "ord", "concept_id", "period", F.col("marks").alias("weight"), F.lit(60).alias("total"))
    return A.apportion(i, ["package_id"], ["ord", "concept_id", "period", "weight"]).select("package_id", "ord", F.col("part").alias("minutes"))


def round_robin_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Item kinds of each customer's packages in turns, the most frequent first."""
    o = table(spark, sf, "orders")
    counts = o.groupBy(F.col("o_custkey").alias("package_id"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("count"))
    return A.round_robin(counts, ["package_id"]).select("package_id", "kind", F.col("turn").cast("long"), F.col("position").cast("long"))


def _edges(spark, sf):
    """A graph per supplier: its parts, each before the next in the order of lines; every 50th line turns an edge round."""
    i = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 100 + F.col("l_orderkey") % 40).alias("package_id"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("c"))
    w = Window.partitionBy("package_id").orderBy("l_orderkey", "l_linenumber", "c")
    e = i.withColumn("ord", F.row_number().over(w)).withColumn("n", F.lead("c").over(w)).where("n is not null")
    turned = F.col("ord") % 3 == 0
    return e.select("package_id", "ord", F.when(turned, F.col("n")).otherwise(F.col("c")).alias("from_id"), F.when(turned, F.col("c")).otherwise(F.col("n")).alias("to_id"), F.lit("prerequisite_of").alias("relation"), (F.col("ord") % 10 / 10).alias("confidence"))


def _nodes(edges):
    return edges.select("package_id", F.col("from_id").alias("concept_id")).unionByName(edges.select("package_id", F.col("to_id").alias("concept_id"))).distinct()


def _known(edges):
    """The nodes less every tenth, so that cleaning finds unknown ends."""
    return _nodes(edges).where("concept_id % 10 <> 3")


def clean_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that remain after self loops, unknown ends and repetitions go, by package."""
    e = _edges(spark, sf)
    return graphs.clean_edges(e, _known(e)).groupBy("package_id").agg(F.count("*").alias("n_edges"), F.sum("ord").alias("ords"), F.round(F.sum("confidence"), 6).alias("confidence"))


def cycle_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges on or between cycles after peeling, by package."""
    e = _edges(spark, sf)
    return graphs.cyclic_edges(graphs.clean_edges(e, _nodes(e)), _scratch).groupBy("package_id").agg(F.count("*").alias("n_edges"))


def broken_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that repair takes out of each package's graph."""
    e = _scratch(_edges(spark, sf))
    fixed = graphs.break_cycles(graphs.clean_edges(e, _nodes(e)))
    return fixed.groupBy("package_id").agg(F.count("*").alias("n_edges"), F.count_if("dropped").alias("n_dropped"))


def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every concept in its package's teaching order."""
    edges = _scratch(_edges(spark, sf))  # read by four branches
    nodes = _nodes(edges)
    return graphs.topological_order(nodes.withColumn("rank", F.col("concept_id")), graphs.clean_edges(edges, nodes).select("package_id", "from_id", "to_id"))


def downstream_load(spark: SparkSession, sf: str) -> DataFrame:
    """How many other concepts each concept leads to, over all edges and any number of steps."""
    return graphs.downstream(_edges(spark, sf), _scratch)


def gap_severity_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten gravest gaps of every customer: each order is a gap, its priority the reach of its concept."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("gap_id"), F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0).alias("reach"), F.when(F.col("o_totalprice") > 300000, "core").otherwise("supporting").alias("importance"), (F.col("o_orderstatus") == "F").alias("observed"))
    g = o.withColumn("severity", graphs.severity(F.col("reach"), F.col("importance")))
    return graphs.top_gaps(g).select("package_id", "gap_id", "severity", F.col("rank").cast("long"))


def mutation_delta(spark: SparkSession, sf: str) -> DataFrame:
    """A damaged copy of every package scored beside the original: variants are rows of one corpus, and the drop is what a check must see."""
    items = _items(spark, sf)
    known = _concepts(spark, sf, known=True).select("concept_id").withColumn("known", F.lit(1))
    damaged = items.withColumn("concept_id", F.when(F.col("ord") % 2 == 0, F.lit(-1)).otherwise(F.col("concept_id")))
    both = items.withColumn("variant", F.lit("baseline")).unionByName(damaged.withColumn("variant", F.lit("dangling")))
    s = both.join(known, "concept_id", "left").groupBy("package_id", "variant").agg(S.share(F.count("known"), F.count("*")).alias("score"))
    p = s.groupBy("package_id").agg(F.max(F.when(F.col("variant") == "baseline", F.col("score"))).alias("a"), F.max(F.when(F.col("variant") == "dangling", F.col("score"))).alias("b"))
    return p.select("package_id", F.round("a", 6).alias("baseline"), F.round("b", 6).alias("damaged"), (F.col("a") - F.col("b") >= 0.05).alias("noticed"))


def markdown_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's packages as one Markdown text, in order."""
    o = table(spark, sf, "orders")
    line = F.concat(F.lit("- "), F.col("o_orderkey").cast("string"), F.lit(" ("), "o_orderpriority", F.lit(")"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("rows"))
    return g.select("o_custkey", F.concat(F.lit("# Customer "), F.col("o_custkey").cast("string"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))


_I = """i AS (SELECT l_orderkey AS package_id, l_linenumber AS ord, l_partkey AS concept_id, l_suppkey AS period,
  CASE l_returnflag WHEN 'A' THEN 'mcq' WHEN 'N' THEN 'short_answer' ELSE 'long_answer' END AS kind,
  CASE WHEN l_quantity < 10 THEN 'remember' WHEN l_quantity < 20 THEN 'understand' WHEN l_quantity < 30 THEN 'apply' WHEN l_quantity < 40 THEN 'analyze' ELSE 'evaluate' END AS bloom,
  l_quantity::BIGINT AS marks, l_linestatus AS status FROM lineitem),
  c AS (SELECT p_partkey AS concept_id, p_name AS name, CASE WHEN p_size >= 35 THEN 'core' WHEN p_size >= 15 THEN 'supporting' ELSE 'enrichment' END AS importance, p_size FROM part)"""
_KNOWN = f"{_I}, d AS (SELECT * FROM c WHERE concept_id % 10 <> 3)"
_E = """s AS (SELECT l_suppkey * 100 + l_orderkey % 40 AS package_id, l_orderkey, l_linenumber, l_partkey AS c FROM lineitem),
  r AS (SELECT package_id, c, row_number() OVER w AS ord, lead(c) OVER w AS n FROM s WINDOW w AS (PARTITION BY package_id ORDER BY l_orderkey, l_linenumber, c)),
  e AS (SELECT package_id, ord, CASE WHEN ord % 3 = 0 THEN n ELSE c END AS from_id, CASE WHEN ord % 3 = 0 THEN c ELSE n END AS to_id, (ord % 10) / 10.0::DOUBLE AS confidence FROM r WHERE n IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "anti_untaught": f"WITH {_I} SELECT concept_id, name FROM c WHERE concept_id NOT IN (SELECT concept_id FROM i WHERE status = 'F' AND marks >= 45)",
    "dangling_refs": f"WITH {_KNOWN} SELECT package_id, count(*) AS n_dangling, min(concept_id) AS first_concept FROM i WHERE concept_id NOT IN (SELECT concept_id FROM d) GROUP BY 1",
    "semi_objective_assessed": f"WITH {_I} SELECT o_orderstatus, count(*) AS n_packages FROM orders WHERE o_orderkey IN (SELECT package_id FROM i JOIN c USING (concept_id) WHERE status = 'F' AND importance = 'core') GROUP BY 1",
    "prereq_violations": f"""WITH {_I}, p AS (SELECT package_id, concept_id, arg_min(period, (ord, period)) AS p FROM i GROUP BY 1, 2),
      e AS (SELECT DISTINCT * FROM (SELECT package_id, concept_id AS to_id, lag(concept_id) OVER (PARTITION BY package_id ORDER BY ord, concept_id, period) AS from_id FROM i) WHERE from_id IS NOT NULL AND from_id <> to_id)
      SELECT e.package_id, count(*) AS n_edges, count(*) FILTER (a.p > b.p) AS n_violations FROM e JOIN p a ON a.package_id = e.package_id AND a.concept_id = from_id JOIN p b ON b.package_id = e.package_id AND b.concept_id = to_id GROUP BY 1""",
    "dup_concepts": f"WITH {_I} SELECT lower(name) AS key, count(*) AS n, min(concept_id) AS first_id, max(concept_id) AS last_id FROM c GROUP BY 1 HAVING count(*) > 1",
    "dedup_merge_keyed": f"WITH {_I} SELECT name, arg_min(importance, concept_id) AS importance, string_agg(p_size::VARCHAR, ',' ORDER BY concept_id) AS evidence FROM c GROUP BY 1",
    "timing_mismatch": f"WITH {_I}, p AS (SELECT package_id, period, sum(marks)::BIGINT AS m FROM i GROUP BY 1, 2) SELECT package_id, count(*) AS n_periods, count(*) FILTER (m <> 40) AS n_mismatched, max(abs(m - 40)) AS worst FROM p GROUP BY 1",
    "default_lookup_fallback": "SELECT coalesce(m, 50)::BIGINT AS minutes, count(*) AS n FROM customer LEFT JOIN (VALUES ('building', 45), ('machinery', 40), ('generic', 50)) b(k, m) ON k = lower(trim(c_mktsegment)) GROUP BY 1",
    "blueprint_counts": f"WITH {_I} SELECT package_id, count(*) FILTER (kind = 'mcq') AS mcq, count(*) FILTER (kind = 'short_answer') AS short_answer, count(*) FILTER (kind = 'long_answer') AS long_answer, count(DISTINCT bloom) AS n_levels, sum(marks)::BIGINT AS total_marks FROM i GROUP BY 1",
    "blueprint_full_outer_drift": f"""WITH {_I}, a AS (SELECT period, kind, count(*) AS n FROM i GROUP BY 1, 2), k AS (SELECT period, kind, count(*) AS n FROM i WHERE status = 'F' OR ord = 1 GROUP BY 1, 2 HAVING count(*) > 2)
      SELECT period, kind, coalesce(a.n, 0) AS actual, coalesce(k.n, 0) AS claimed, abs(coalesce(a.n, 0) - coalesce(k.n, 0)) AS drift FROM a FULL JOIN k USING (period, kind)""",
    "marks_consistency": f"WITH {_I}, m AS (SELECT *, CASE kind WHEN 'mcq' THEN 2 WHEN 'short_answer' THEN 4 ELSE 9 END::BIGINT AS expected FROM i) SELECT kind, expected, count(*) AS n, count(*) FILTER (marks <> expected) AS n_off FROM m GROUP BY 1, 2",
    "bloom_mark_share": f"WITH {_I}, g AS (SELECT status, bloom, sum(marks)::DOUBLE AS m FROM i GROUP BY 1, 2), s AS (SELECT *, m / sum(m) OVER (PARTITION BY status) AS p FROM g) SELECT status, bloom, round(p, 6) AS share, p >= 0.05 AS counts FROM s",
    "kind_mix_drift": f"""WITH {_I} SELECT package_id, round(abs(count(*) FILTER (kind = 'mcq')::DOUBLE / count(*) - 0.4::DOUBLE) + abs(count(*) FILTER (kind = 'short_answer')::DOUBLE / count(*) - 0.35::DOUBLE) + abs(count(*) FILTER (kind = 'long_answer')::DOUBLE / count(*) - 0.25::DOUBLE), 6) AS drift FROM i GROUP BY 1""",
    "coverage_metrics": f"""WITH {_I}, a AS (SELECT package_id, count(*) AS n, count(importance) AS k, count(*) FILTER (importance IS NOT NULL AND status = 'F') AS f, count(*) FILTER (importance = 'core') AS nc, count(*) FILTER (importance = 'core' AND marks >= 10) AS cm
      FROM i LEFT JOIN c USING (concept_id) GROUP BY 1), m AS (SELECT package_id, coalesce(k::DOUBLE / nullif(n, 0), 1) AS t, coalesce(f::DOUBLE / nullif(k, 0), 1) AS s, coalesce(cm::DOUBLE / nullif(nc, 0), 1) AS cm, CASE WHEN nc > 0 THEN 0.06 ELSE 0 END::DOUBLE AS w FROM a)
      SELECT package_id, round(t, 6) AS taught, round(s, 6) AS assessed, round(cm, 6) AS core_marked, round((t * 0.16::DOUBLE + s * 0.16::DOUBLE + cm * w) / (0.32::DOUBLE + w) * 100, 4) AS score FROM m""",
    "sequencing_load_balance": f"WITH {_I}, p AS (SELECT package_id, period, sum(marks)::BIGINT AS l FROM i GROUP BY 1, 2) SELECT package_id, count(*) AS n_periods, round((max(l) - min(l))::DOUBLE / nullif(avg(l), 0), 6) AS imbalance FROM p GROUP BY 1",
    "adjacent_rubric_diff": f"WITH {_I}, w AS (SELECT package_id, bloom, lag(bloom) OVER (PARTITION BY package_id ORDER BY ord, concept_id, period, bloom) AS b FROM i) SELECT package_id, round(coalesce(count(*) FILTER (bloom <> b)::DOUBLE / nullif(count(b), 0), 0), 6) AS differing FROM w GROUP BY 1",
    "distinct_terms_once": """WITH t AS (SELECT DISTINCT p_brand, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_size), '\\s+')) AS term FROM part)
      SELECT term, min(p_brand) AS brand FROM t WHERE length(term) >= 2 GROUP BY 1 HAVING count(*) = 1""",
    "period_count": f"""WITH {_I}, a AS (SELECT package_id, count(*) AS n, sum(CASE importance WHEN 'core' THEN 1.0 WHEN 'supporting' THEN 0.5 WHEN 'enrichment' THEN 0.25 ELSE 0.5 END::DOUBLE) AS l FROM i LEFT JOIN c USING (concept_id) GROUP BY 1)
      SELECT package_id, greatest(1, least(ceil(l / (20.0::DOUBLE / 12)), 20, greatest(n, 1)))::BIGINT AS periods, greatest(6, least(2 * n + n // 2, 24))::BIGINT AS items FROM a""",
    "apportion_minutes": f"""WITH {_I}, x AS (SELECT package_id, ord, concept_id, period, marks, marks * 60 / sum(marks) OVER (PARTITION BY package_id)::DOUBLE AS e FROM i), f AS (SELECT *, floor(e) AS f, 60 - sum(floor(e)) OVER (PARTITION BY package_id) AS rest FROM x)
      SELECT package_id, ord, (f + CASE WHEN row_number() OVER (PARTITION BY package_id ORDER BY e - f DESC, ord, concept_id, period, marks) <= rest THEN 1 ELSE 0 END)::BIGINT AS minutes FROM f""",
    "round_robin_slots": """WITH k AS (SELECT o_custkey AS package_id, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY n DESC, kind) AS rk FROM k), x AS (SELECT *, unnest(range(1, n + 1)) AS turn FROM r)
      SELECT package_id, kind, turn, row_number() OVER (PARTITION BY package_id ORDER BY turn, rk) AS position FROM x""",
    "clean_edges": f"""WITH {_E}, k AS (SELECT * FROM e WHERE from_id <> to_id AND from_id % 10 <> 3 AND to_id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY package_id, from_id, to_id ORDER BY ord) = 1)
      SELECT package_id, count(*) AS n_edges, sum(ord)::BIGINT AS ords, round(sum(confidence), 6) AS confidence FROM k GROUP BY 1""",
    "cycle_edges": f"""WITH RECURSIVE {_E}, g AS (SELECT DISTINCT package_id, from_id, to_id FROM e WHERE from_id <> to_id), t AS (SELECT * FROM g UNION SELECT t.package_id, t.from_id, g.to_id FROM t JOIN g ON g.package_id = t.package_id AND g.from_id = t.to_id),
      o AS (SELECT package_id, from_id AS c FROM t WHERE from_id = to_id), up AS (SELECT * FROM o UNION SELECT t.package_id, t.to_id FROM t JOIN o ON o.package_id = t.package_id AND o.c = t.from_id), down AS (SELECT * FROM o UNION SELECT t.package_id, t.from_id FROM t JOIN o ON o.package_id = t.package_id AND o.c = t.to_id)
      SELECT package_id, count(*) AS n_edges FROM g WHERE (package_id, from_id) IN (SELECT (package_id, c) FROM up) AND (package_id, to_id) IN (SELECT (package_id, c) FROM down) GROUP BY 1""",
    "band_partition_dp": f"""WITH {_I}, r AS (SELECT package_id, row_number() OVER w AS k, sum(marks) OVER w AS p, count(*) OVER (PARTITION BY package_id) AS n, sum(marks) OVER (PARTITION BY package_id) AS t FROM i WINDOW w AS (PARTITION BY package_id ORDER BY ord, marks ROWS UNBOUNDED PRECEDING)),
      x AS (SELECT a.package_id, a.n, a.k AS i, b.k AS j FROM r a JOIN r b ON a.package_id = b.package_id AND a.k < b.k AND b.k < b.n QUALIFY row_number() OVER (PARTITION BY a.package_id ORDER BY greatest(a.p, b.p - a.p, b.t - b.p), b.k, greatest(a.p, b.p - a.p), a.k) = 1),
      s AS (SELECT r.package_id, r.k, r.p - coalesce(lag(r.p) OVER (PARTITION BY r.package_id ORDER BY r.k), 0) AS load, CASE WHEN x.i IS NULL THEN r.k - 1 ELSE (r.k > x.i)::INT + (r.k > x.j)::INT END AS band FROM r LEFT JOIN x USING (package_id))
      SELECT package_id, band::BIGINT AS band, count(*) AS n, sum(load)::BIGINT AS load FROM s GROUP BY 1, 2""",
    "downstream_load": f"""WITH RECURSIVE {_E}, g AS (SELECT DISTINCT package_id, from_id, to_id FROM e WHERE from_id <> to_id), t AS (SELECT * FROM g UNION SELECT t.package_id, t.from_id, g.to_id FROM t JOIN g ON g.package_id = t.package_id AND g.from_id = t.to_id)
      SELECT package_id, from_id AS concept_id, count(*) AS reach FROM t WHERE from_id <> to_id GROUP BY 1, 2""",
    "gap_severity_topk": """WITH g AS (SELECT o_custkey AS package_id, o_orderkey AS gap_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' OR o_totalprice > 300000 THEN 'medium' ELSE 'low' END AS severity, o_orderstatus = 'F' AS observed FROM orders)
      SELECT package_id, gap_id, severity, row_number() OVER (PARTITION BY package_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, observed DESC, gap_id) AS rank FROM g QUALIFY rank <= 10""",
    "mutation_delta": f"""WITH {_KNOWN}, m AS (SELECT package_id, count(d.concept_id)::DOUBLE / count(*) AS a, (count(d.concept_id) FILTER (ord % 2 <> 0))::DOUBLE / count(*) AS b FROM i LEFT JOIN d USING (concept_id) GROUP BY 1)
      SELECT package_id, round(a, 6) AS baseline, round(b, 6) AS damaged, a - b >= 0.05 AS noticed FROM m""",
    "markdown_rollup": "SELECT o_custkey, '# Customer ' || o_custkey || chr(10) || string_agg('- ' || o_orderkey || ' (' || o_orderpriority || ')', chr(10) ORDER BY o_orderkey) AS markdown FROM orders GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (
    anti_untaught, dangling_refs, semi_objective_assessed, prereq_violations, dup_concepts, dedup_merge_keyed, timing_mismatch, default_lookup_fallback, blueprint_counts, blueprint_full_outer_drift,
    marks_consistency, bloom_mark_share, kind_mix_drift, coverage_metrics, sequencing_load_balance, adjacent_rubric_diff, distinct_terms_once, period_count, band_partition_dp, apportion_minutes,
    round_robin_slots, clean_edges, cycle_edges, broken_cycles, topo_levels, downstream_load, gap_severity_topk, mutation_delta, markdown_rollup,
)}
