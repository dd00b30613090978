"""Queries over the planning operators: script windows, activity slots, rebuilt items, rubric ladders, type sizes, pages, tables and seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import allocation as A
from ..operators import assembly as B
from ..operators import structure
from ..session import table

POOL = ("game", "debate", "drawing", "experiment", "quiz")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines: an order is a package, every four lines a period of 30 to 60 minutes."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    i = table(spark, sf, "lineitem").withColumn("ord", F.row_number().over(w).cast("long"))
    return i.select(
        F.col("l_orderkey").alias("package_id"), "ord", F.floor((F.col("ord") + 3) / 4).cast("long").alias("period_no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("q"),
        (F.lit(30) + F.col("l_orderkey") % 4 * 10).cast("int").alias("duration"),
    )


def script_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """A period's segments one after another over its duration; every ninth has no minutes."""
    return A.script_windows(_lines(spark, sf).withColumn("minutes", F.when(F.col("part") % 9 != 0, F.col("q"))))


def activity_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The activities of every period, from its number of concepts and the minutes of its slots (a line is one)."""
    p = _lines(spark, sf).groupBy("package_id", "period_no", "duration").agg(F.count_distinct("part").alias("n_concepts"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "q"))), lambda x: x["q"]).alias("slots"))
    return A.activity_slots(p, list(POOL))


def rebuilt_items(spark: SparkSession, sf: str) -> DataFrame:
    """Multiple-choice items of a line's part and its neighbours' names after blank and repeated options are gone; how many options are left, which is right, none where an item cannot be saved."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type", "p_brand")
    option = lambda text, right, why: F.struct(text.alias("text"), right.alias("is_correct"), F.lit(why).alias("why"))
    x = _lines(spark, sf).join(parts, "part")
    blank = F.when(F.col("supp") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    o = F.array(option(F.col("p_name"), F.col("part") % 7 != 0, "a"), option(F.col("p_type"), F.col("supp") % 11 == 0, "b"), option(blank, F.col("q") % 5 == 0, "c"), option(F.when(F.col("q") % 2 == 0, F.col("p_brand")), F.lit(False), "d"), option(F.lower("p_type"), F.lit(None).cast("boolean"), "e"))
    x = x.select("package_id", "ord", A.rebuilt_options(o).alias("o"))
    return x.select("package_id", "ord", F.greatest(F.coalesce(F.size("o"), F.lit(0)), F.lit(0)).cast("long").alias("n_options"), F.get(F.filter("o", lambda y: y["is_correct"]), F.lit(0))["text"].alias("right"), F.array_join(F.transform("o", lambda y: y["why"]), "").alias("kept"))


def rubric_ladders(spark: SparkSession, sf: str) -> DataFrame:
    """The levels of the fallback rubric for each number of marks, and how many items take it."""
    m = _lines(spark, sf).select((F.col("q") % 12 + 1).alias("marks"))
    return m.groupBy("marks", F.array_join(F.transform(A.rubric_ladder(F.col("marks")), lambda x: x.cast("string")), ",").alias("levels")).agg(F.count("*").alias("n"))


def body_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The type size of most of each document's characters; a line is a span, its size follows from its length."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(structure.lines_of(F.col("text"))).alias("ord", "text"))
    return structure.body_font(lines.withColumn("size", 10 + F.length("text") % 4 * 0.5)).select("doc_id", "body_size")


def picture_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as pages: those that are pictures of text, by kind."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(structure.lines_of(F.col("text"))).alias("page", "text"))
    kind = F.when(F.col("page") % 3 == 0, "sparse").when(F.col("page") % 3 == 1, "dense").otherwise("plain")
    p = lines.select("doc_id", "page", kind.alias("kind"), F.length("text").alias("chars"), (F.lit(10.0) + F.col("doc_id") % 40).alias("area"), (F.col("doc_id") % 10 / 10).alias("image_share"))
    return structure.scanned_pages(p).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("chars").alias("chars"))


def ragged_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's lines as rows of a table, their words as cells, made rectangular by the first: its width, filled and kept cells."""
    d = table(spark, sf, "documents").select("doc_id", structure.lines_of(F.col("text")).alias("lines"))
    rows = F.transform("lines", lambda x: F.transform(F.split(x, " "), lambda c: F.when(c != "", c)))
    d = d.where(F.size("lines") > 0).select("doc_id", F.explode(F.array(structure.normalise_table(rows))).alias("t"))
    cells = F.flatten("t")
    return d.select("doc_id", F.size(F.get("t", F.lit(0))).cast("long").alias("width"), F.size("t").cast("long").alias("n_rows"), F.size(F.filter(cells, lambda c: c == "")).cast("long").alias("n_empty"), F.md5(F.array_join(cells, "|")).alias("cells_md5"))


def turn_seams(spark: SparkSession, sf: str) -> DataFrame:
    """How far each turn's beginning repeats the end of the one before; every third is given the end of it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before is not null")
    t = t.withColumn("text", F.when(F.col("turn") % 3 == 1, F.concat(F.expr("right(before, 7 + turn)"), "text")).otherwise(F.col("text")))
    return t.select("conv_id", "turn", structure.seam_length(F.col("text"), F.col("before"), 60).cast("long").alias("seam"))


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their parts' names, and a blank text where a remainder says so."""
    return _lines(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type", "p_brand"), "part")


def _blank(when, text):
    return F.when(when, F.lit("  ")).otherwise(text)


def assembled_activities(spark: SparkSession, sf: str) -> DataFrame:
    """Activities of every line's slot and draft, with what was derived."""
    d, c = _drafts(spark, sf), F.col
    return B.activities(d.select(
        "package_id", F.concat(F.lit("a"), "ord").alias("activity_id"), F.lit("gallery_walk").alias("type"), (c("q") % 12).cast("int").alias("minutes"), F.concat(F.lit("Lesson "), "period_no").alias("period_title"), F.when(c("part") % 4 != 0, F.array("p_name", "p_type")).alias("names"),
        _blank(c("supp") % 3 == 0, F.lit(" Walk ")).alias("title"), F.array(_blank(c("q") % 2 == 0, F.lit(" Go ")), F.lit("")).alias("steps"), F.when(c("q") % 3 != 0, F.array(F.lit("Said"))).alias("criteria"), _blank(c("part") % 5 == 0, c("p_brand")).alias("support"), F.when(c("part") % 7 != 0, c("p_type")).alias("extension"),
    )).select("package_id", "activity_id", "title", F.array_join("steps", "|").alias("steps"), F.array_join("criteria", "|").alias("criteria"), "support", "extension", F.array_join("notes", ",").alias("notes"))


def assembled_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of every line's seed and draft, with what was derived, or why there is none."""
    d, c = _drafts(spark, sf), F.col
    return B.gaps(d.select(
        "package_id", c("ord").alias("gap_id"), F.when(c("part") % 3 != 0, c("p_type")).alias("known"), _blank(c("supp") % 2 == 0, c("p_brand")).alias("correction"), _blank(c("part") % 2 == 0, c("p_name")).alias("misconception"),
        F.array(F.struct(_blank(c("q") % 5 == 0, F.lit("Why?")).alias("question"), _blank(c("q") % 2 == 0, F.lit("r")).alias("reveals"), F.lit(" ").alias("wrong"))).alias("diagnostics"),
        F.array(F.struct(_blank(c("q") % 3 == 0, F.lit("Do")).alias("action"), F.lit(None).cast("string").alias("rationale"), (c("q") % 4).cast("int").alias("minutes"))).alias("remediation"),
    )).select("package_id", "gap_id", "refused", "misconception", F.array_join(F.transform("diagnostics", lambda x: x["reveals"]), "|").alias("reveals"), F.array_join(F.transform("remediation", lambda x: F.concat_ws(":", x["action"], x["rationale"], x["minutes"].cast("string"))), "|").alias("steps"), F.array_join("notes", ",").alias("notes"))


def assembled_items(spark: SparkSession, sf: str) -> DataFrame:
    """Constructed items of every line's spec and draft, with the ladder or the draft's levels, or why there is none."""
    d, c = _drafts(spark, sf), F.col
    level = lambda label, text, marks: F.struct(F.lit(label).alias("label"), text.alias("descriptor"), marks.cast("int").alias("marks"))
    levels = F.slice(F.array(level("top", c("p_name"), c("q") % 4 + 2), level("low", _blank(c("supp") % 4 == 0, c("p_type")), c("part") % 3), level("none", F.lit("x"), F.lit(-1))), F.lit(1), (c("supp") % 3 * 2).cast("int"))
    return B.constructed_items(d.select(
        "package_id", c("ord").alias("item_id"), F.when(c("q") % 2 == 0, "numerical").otherwise("long_answer").alias("kind"), (c("q") % 6 + 2).cast("int").alias("marks"), _blank(c("part") % 11 == 0, c("p_name")).alias("stem"), _blank(c("part") % 13 == 0, c("p_type")).alias("answer"),
        F.when(c("q") % 4 == 0, F.lit("w")).alias("working"), F.when(c("supp") % 5 == 0, F.lit("c")).alias("criteria"), levels.alias("levels"),
    )).select("package_id", "item_id", "refused", "criteria", F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["label"], x["descriptor"], x["marks"].cast("string"))), "|").alias("levels"), F.array_join("notes", ",").alias("notes"))


_L = """l AS (SELECT l_orderkey AS package_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_partkey AS part, l_suppkey AS supp, l_quantity::BIGINT AS q, (30 + l_orderkey % 4 * 10)::INT AS duration FROM lineitem),
  p AS (SELECT *, (ord + 3) // 4 AS period_no FROM l)"""
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
ORACLES: dict[str, str] = {
    "script_timeline": f"""WITH {_L}, s AS (SELECT *, CASE WHEN part % 9 <> 0 THEN q ELSE 0 END AS minutes FROM p), u AS (SELECT *, sum(minutes) OVER (PARTITION BY package_id, period_no ORDER BY ord)::BIGINT AS upto, sum(minutes) OVER (PARTITION BY package_id, period_no)::BIGINT AS every FROM s)
      SELECT package_id, period_no, ord, round_even((upto - minutes) * duration / every::DOUBLE, 0)::INT AS start, round_even(upto * duration / every::DOUBLE, 0)::INT AS stop FROM u WHERE every > 0""",
    "activity_plan": f"""WITH {_L}, g AS (SELECT package_id, period_no, duration, count(DISTINCT part) AS c, list(q ORDER BY ord) AS s FROM p GROUP BY 1, 2, 3), m AS (SELECT *, CASE WHEN len(s) >= 3 THEN list_max(s[2:len(s) - 1]) ELSE round_even(duration * 0.45::DOUBLE, 0) END::INT AS long, greatest(8, floor(duration * 0.45::DOUBLE)) AS most FROM g),
      n AS (SELECT *, CASE WHEN c >= 3 AND greatest(8, least(long, most)) >= 16 THEN 2 ELSE 1 END AS n FROM m), k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n)
      SELECT package_id, period_no, 'act_p' || period_no || '_' || k AS activity_id, (['{"', '".join(POOL)}'])[(row_number() OVER (PARTITION BY package_id ORDER BY period_no, k) - 1) % {len(POOL)} + 1] AS type, greatest(8, least(long // n, most))::INT AS minutes FROM k""",
    "rebuilt_items": f"""WITH {_L}, o AS (SELECT package_id, ord, unnest([p_name, p_type, CASE WHEN supp % 3 = 0 THEN '  ' ELSE ' ' || upper(p_name) END, CASE WHEN q % 2 = 0 THEN p_brand END, lower(p_type)]) AS t, unnest([part % 7 <> 0, supp % 11 = 0, q % 5 = 0, false, NULL]) AS c, unnest(['a', 'b', 'c', 'd', 'e']) AS w FROM p JOIN part ON p_partkey = part),
      f AS (SELECT package_id, ord, lower(trim(t)) AS k, arg_min(trim(t), w) AS t, min(w) AS w, bool_or(coalesce(c, false)) AS c FROM o WHERE trim(coalesce(t, '')) <> '' GROUP BY 1, 2, 3),
      r AS (SELECT package_id, ord, count(*) AS n, count(*) FILTER (c) AS ok, max(t) FILTER (c) AS t, string_agg(w, '' ORDER BY w) AS ws FROM f GROUP BY 1, 2)
      SELECT package_id, ord, CASE WHEN n >= 2 AND ok = 1 THEN n ELSE 0 END AS n_options, CASE WHEN n >= 2 AND ok = 1 THEN t END AS right, CASE WHEN n >= 2 AND ok = 1 THEN ws END AS kept FROM r""",
    "rubric_ladders": f"""WITH {_L}, m AS (SELECT q % 12 + 1 AS marks FROM p) SELECT marks, array_to_string(list_transform(CASE WHEN marks >= 6 THEN [1, 0.75, 0.5, 0.25]::DOUBLE[] WHEN marks >= 3 THEN [1, 0.6, 0.3]::DOUBLE[] ELSE [1, 0.5]::DOUBLE[] END, lambda s: round_even(marks * s, 0)::INT::VARCHAR), ',') AS levels, count(*) AS n FROM m GROUP BY 1, 2""",
    "body_sizes": f"""WITH s AS (SELECT doc_id, unnest({_LINES}) AS t, unnest(range(len({_LINES}))) AS ord FROM documents), g AS (SELECT doc_id, 10 + length(t) % 4 * 0.5::DOUBLE AS size, sum(length(t)) AS n, min(ord) AS first FROM s GROUP BY 1, 2)
      SELECT doc_id, size AS body_size FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""",
    "picture_pages": f"""WITH s AS (SELECT doc_id, unnest({_LINES}) AS t, unnest(range(len({_LINES}))) AS page FROM documents), p AS (SELECT doc_id, (['sparse', 'dense', 'plain'])[page % 3 + 1] AS kind, length(t) AS chars, 10.0 + doc_id % 40 AS area, doc_id % 10 / 10.0 AS image FROM s)
      SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(chars)::BIGINT AS chars FROM p WHERE chars < CASE kind WHEN 'sparse' THEN 30 WHEN 'dense' THEN 90 ELSE 60 END AND chars / area < 3 AND image >= 0.55 GROUP BY 1""",
    "ragged_tables": f"""WITH d AS (SELECT doc_id, list_transform({_LINES}, lambda x: string_split(x, ' ')) AS r FROM documents), w AS (SELECT doc_id, len(r[1]) AS width, r FROM d WHERE len(r) > 0), t AS (SELECT doc_id, width, len(r) AS n_rows, flatten(list_transform(r, lambda x: list_concat(x, list_resize(['']::VARCHAR[], width, ''))[1:width])) AS c FROM w)
      SELECT doc_id, width, n_rows, len(list_filter(c, lambda x: x = '')) AS n_empty, md5(array_to_string(c, '|')) AS cells_md5 FROM t""",
    "assembled_activities": f"""WITH {_L}, d AS (SELECT *, CASE WHEN part % 4 <> 0 THEN p_name || ', ' || p_type ELSE 'Lesson ' || period_no END AS s, CASE WHEN part % 4 <> 0 THEN p_name ELSE 'Lesson ' || period_no END AS s1 FROM p JOIN part ON p_partkey = part)
      SELECT package_id, 'a' || ord AS activity_id, CASE WHEN supp % 3 = 0 THEN 'Gallery Walk: ' || s ELSE 'Walk' END AS title, CASE WHEN q % 2 = 0 THEN 'Prepare the gallery walk on ' || s || '|Let it run ' || greatest(q % 12 - 4, 1) || ' minutes and listen at each table|Collect two answers on ' || s || ' and correct one mistake' ELSE 'Go' END AS steps,
        CASE WHEN q % 3 = 0 THEN 'Every group says in its own words what ' || s1 || ' is|Every group hands its result in on time' ELSE 'Said' END AS criteria, CASE WHEN part % 5 = 0 THEN 'Show one finished example of ' || s ELSE p_brand END AS support, CASE WHEN part % 7 = 0 THEN 'Find a case in which ' || s || ' comes out differently' ELSE p_type END AS extension,
        concat_ws(',', CASE WHEN q % 2 = 0 THEN 'STEPS_DERIVED' END, CASE WHEN q % 3 = 0 THEN 'CRITERIA_DERIVED' END, CASE WHEN part % 5 = 0 OR part % 7 = 0 THEN 'SCAFFOLD_DERIVED' END) AS notes FROM d""",
    "assembled_gaps": f"""WITH {_L}, d AS (SELECT *, CASE WHEN part % 2 <> 0 THEN p_name WHEN part % 3 <> 0 THEN p_type END AS m FROM p JOIN part ON p_partkey = part),
      e AS (SELECT *, CASE WHEN m IS NULL THEN 'NO_MISCONCEPTION' WHEN q % 5 = 0 THEN 'NO_DIAGNOSTIC' WHEN q % 3 = 0 AND supp % 2 = 0 THEN 'NO_REMEDIATION' END AS refused FROM d)
      SELECT package_id, ord AS gap_id, refused, CASE WHEN refused IS NULL THEN m END AS misconception, CASE WHEN refused IS NULL THEN CASE WHEN q % 2 = 0 THEN 'Still believes: ' || m ELSE 'r' END END AS reveals,
        CASE WHEN refused IS NULL THEN CASE WHEN q % 3 = 0 THEN p_brand || ':The source corrects it so' ELSE concat_ws(':', 'Do', 'Answers: ' || m, CASE WHEN q % 4 >= 1 THEN q % 4 END) END END AS steps, CASE WHEN refused IS NULL AND q % 3 = 0 THEN 'CORRECTION_USED' ELSE '' END AS notes FROM e""",
    "assembled_items": f"""WITH {_L}, d AS (SELECT *, q % 6 + 2 AS marks, part % 11 = 0 OR part % 13 = 0 AS lost, supp % 3 AS k, q % 4 + 2 AS top, part % 3 AS low FROM p JOIN part ON p_partkey = part),
      e AS (SELECT *, CASE WHEN k = 0 THEN 'LADDER_FOR_NONE' WHEN supp % 4 = 0 OR top = low THEN 'LADDER_FOR_EQUAL' WHEN greatest(top, low) > marks THEN 'LADDER_FOR_EXCESS' END AS why FROM d),
      f AS (SELECT *, list_transform(CASE WHEN marks >= 6 THEN [1, 0.75, 0.5, 0.25]::DOUBLE[] WHEN marks >= 3 THEN [1, 0.6, 0.3]::DOUBLE[] ELSE [1, 0.5]::DOUBLE[] END, lambda s: round_even(marks * s, 0)::INT) AS ms FROM e)
      SELECT package_id, ord AS item_id, CASE WHEN lost THEN 'NO_TEXT' END AS refused, CASE WHEN NOT lost THEN CASE WHEN supp % 5 = 0 THEN 'c' ELSE 'How right and whole the answer is to: ' || p_name END END AS criteria,
        CASE WHEN NOT lost THEN CASE WHEN why IS NULL THEN 'top:' || p_name || ':' || top || '|low:' || p_type || ':' || low ELSE array_to_string(list_transform(range(1, len(ms) + 1), lambda i: (['complete', 'mostly there', 'begun', 'barely begun'])[i] || CASE WHEN i = 1 THEN ':Gives in full: ' ELSE ':Gives ' || ms[i] || ' marks'' worth of: ' END || p_type || ':' || ms[i]), '|') END END AS levels,
        CASE WHEN lost THEN '' ELSE concat_ws(',', why, CASE WHEN q % 2 = 0 AND q % 4 <> 0 THEN 'NO_WORKING' END) END AS notes FROM f""",
    "turn_seams": """WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations), u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN right(b, 7 + turn) || text ELSE text END AS t, b FROM t WHERE b IS NOT NULL)
      SELECT conv_id, turn, coalesce(list_max(list_filter(range(0, least(length(t), length(b), 60) + 1), lambda n: right(b, n) = t[1:n] OR n = 0)), 0)::BIGINT AS seam FROM u""",
}

QUERIES = {f.__name__: f for f in (script_timeline, activity_plan, rebuilt_items, rubric_ladders, body_sizes, picture_pages, ragged_tables, turn_seams, assembled_activities, assembled_gaps, assembled_items)}
