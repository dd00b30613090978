"""What the findings of round 3 that were left asked for: damages scored by the stage that must notice them, lookups by distinct text, joins that leave texts where they are."""

from pyspark.sql import functions as F

from corpuscle.operators import allocation, grounding
from corpuscle.operators import packages as P
from corpuscle.operators import retrieval, structure


def test_damages_are_scored_by_their_own_stage_and_measure(spark):
    assert sorted(d for ds in P.DAMAGES_OF.values() for d in ds) == sorted(P.MUTATIONS) == sorted(P.NOTICED_BY)
    rows = [("baseline/7", "answer_key", 80.0), ("dropped_answers/7", "answer_key", 0.0), ("single_bloom/7", "answer_key", 80.0), ("baseline/8", "answer_key", 50.0), ("baseline/9", "answer_key", None), ("dropped_answers/9", "answer_key", 0.0), ("baseline/7", "bloom_spread", 100.0), ("single_bloom/7", "bloom_spread", 33.0)]
    found = P.before_and_after(spark.createDataFrame(rows, "package_id string, measure string, score double"), ("dropped_answers", "single_bloom"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.select("package", "damage", "measure", "before", "after").collect()) == [("7", "dropped_answers", "answer_key", 80.0, 0.0), ("7", "single_bloom", "bloom_spread", 100.0, 33.0)]


def test_a_measure_that_nobody_asked_for_costs_no_plan(spark):
    rows = spark.createDataFrame([(1, True)], "package_id long, ok boolean")
    both = P.share_of(rows, "s", {"one": (1, rows.ok)}).unionByName(P.share_of(rows.where("package_id > 5"), "s", {"two": (2, rows.ok)}))
    assert "package_id#" in (plan := both.where("measure = 'one'")._jdf.queryExecution().optimizedPlan().toString()) and "> 5" not in plan
    assert [tuple(r) for r in both.collect()] == [(1, "s", "one", 1.0, 1.0, 1.0)]


def test_claims_are_split_once_to_find_their_source(spark):
    texts = ["one two three four five six", "unknown words and nothing else at all", "two three", ""]
    claims = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "claim_id string, text string")
    chunks = grounding.tokenised(spark.createDataFrame([(9, "two three four five six seven"), (4, "zero one two three four five")], "chunk_id long, text string"), "text", "span")
    cut = []
    got = grounding.with_sources(claims, "text", chunks, lambda df: cut.append(df) or df)
    assert len(cut) == 1 and cut[0]._jdf.queryExecution().optimizedPlan().toString().count("transform(CASE WHEN (size(claim_tokens") <= 1  # runs are not made again in a filter
    assert {r.claim_id: (r.chunk_id, r.claim_tokens) for r in got.collect()} == {"0": (4, texts[0].split()), "1": (None, []), "2": (4, ["two", "three"]), "3": (None, [])}


def test_retrieval_sends_on_no_more_than_a_chunks_best(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 16)
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)] + [(200, [0.0, 0.0, 0.0]), (201, None), (202, [1.0, None, 2.0]), (203, [1.0, 2.0]), (204, [])]
    v = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = v.where("id in (3, 5, 11, 200, 201, 202)").withColumnRenamed("id", "query_id")
    ranked = retrieval.vector_ranks(v, asked, 5)
    assert "aggregate(zip_with" not in ranked._jdf.queryExecution().optimizedPlan().toString()  # no cosine of each pair as an expression
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)
    want = {q: [i for _, i in sorted((-cos(dict(vectors)[q], x), i) for i, x in vectors[:100])[:5]] for q in (3, 5, 11)}
    got = {}
    for r in ranked.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    docs = spark.createDataFrame([(i, ["mill", "wheel"][: i % 3]) for i in range(60)], "id long, tokens array<string>")
    said = spark.createDataFrame([("a", ["wheel", "wheel"]), ("b", ["mill"]), ("c", ["stone"])], "query_id string, tokens array<string>")
    found = retrieval.lexical_ranks(docs, said, 4).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in found) == [("a", k + 1, 3 * k + 2) for k in range(4)] + [("b", k + 1, 3 * k + 1) for k in range(4)]


def test_a_tables_rows_are_worked_out_once(spark):
    d = spark.createDataFrame([("a b c\nd\n\ne f g h",), ("x",), ("",)], "s string")
    rows = F.transform(F.split("s", "\n"), lambda x: F.filter(F.split(x, " "), lambda c: c != ""))
    made = d.select(structure.normalise_table(rows).alias("t"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(s") == 1
    assert [r.t for r in made.collect()] == [[["a", "b", "c"], ["d", "", ""], ["", "", ""], ["e", "f", "g"]], [["x"]], [[]]]


def test_options_are_cleaned_once(spark):
    d = spark.createDataFrame([([(" A ", False, "a"), ("b", True, "b"), ("a", None, "c"), ("  ", True, "d"), (None, True, "e")],), ([("x", True, "a"), ("X ", False, "b")],), (None,)], "o array<struct<text string, is_correct boolean, why string>>")
    made = d.select(allocation.rebuilt_options(d.o).alias("o"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("transform(o#") == 1
    assert [r.o and [tuple(x) for x in r.o] for r in made.collect()] == [[("A", False, "a"), ("b", True, "b")], None, None]
