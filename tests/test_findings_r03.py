"""What the findings of round 3 asked for: values worked out once, plans that are cut, folds by Arrow batch, history without a cap."""

from pyspark.sql import functions as F

from corpuscle.functions import lexicon as L
from corpuscle.functions import text as T
from corpuscle.operators import graphs, rubric, scoring
from corpuscle.plans import operations
from corpuscle.plans import rubric as plans


def test_fixed_lists_are_one_literal_and_values_are_worked_out_once(spark):
    df = spark.createDataFrame([("Show the mill wheel",)], "s string")
    plan = df.select(L.mentions_vocabulary(T.word_tokens(F.lower("s")), F.array(F.lit("mill"), F.lit("old mill"))).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2  # tokens, and the tokens that are joined; not again in the test of each term
    assert len(L.words([str(i) for i in range(500)])._jc.toString()) < 5000
    assert df.select(F.size(L.words([])).alias("n"), L.words(["a", "b c"]).alias("w")).first() == (0, ["a", "b c"])


def test_documents_deal_out_lines_alone(spark, sf):
    plan = plans.documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Window" not in plan  # a package's texts are neither sorted, shuffled nor grouped again


def test_judges_cut_their_plans(spark, sf):
    packages = plans._packages(spark, sf)
    cut = []
    for judge in (rubric.period_integrity, rubric.classroom, rubric.content_fidelity):
        judge(packages, materialize=lambda df: cut.append(1) or df)
    assert len(cut) >= 9


def test_cycles_are_broken_and_order_kept_for_ids_that_are_texts(spark):
    rows = [(1, 1, "a", "b", "prerequisite_of", 0.9), (1, 2, "b", "c", "prerequisite_of", 0.2), (1, 3, "c", "a", "prerequisite_of", 0.5), (1, 4, "c", "a", "part_of", 0.1), (2, 1, "x", "y", "part_of", 1.0)]
    e = spark.createDataFrame(rows, "package_id long, ord long, from_id string, to_id string, relation string, confidence double")
    fixed = graphs.break_cycles(e)
    assert "FlatMapGroupsInPandas" not in fixed._jdf.queryExecution().toString()  # no call for each package
    assert fixed.columns == [*e.columns, "dropped"] and [(r.package_id, r.ord) for r in fixed.collect() if r.dropped] == [(1, 2)]
    nodes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (3, "z", 1)], "package_id long, concept_id string, rank long")
    order = graphs.topological_order(nodes, fixed.where("not dropped"))
    assert "FlatMapCoGroupsInPandas" not in order._jdf.queryExecution().toString()
    assert sorted((r.package_id, r.position, r.concept_id) for r in order.collect()) == [(1, 0, "c"), (1, 1, "a"), (1, 2, "b"), (3, 0, "z")]


def test_history_has_no_cap(spark, monkeypatch):
    runs = [(i, i % 3, "p", "F", float(i), i) for i in range(3000)]
    h = spark.createDataFrame(runs, "run_id long, package_id long, profile string, stage string, score double, evaluated_at long")
    monkeypatch.setattr(operations, "_history", lambda *_: h)
    assert operations.benchmark_distribution(spark, "").first().n == 3000
    assert {r.package_id: r.delta for r in operations.regression_compare(spark, "").collect()} == {0: 2997 - 1499.0, 1: 2998 - 1499.0, 2: 2999 - 1499.0}
    assert scoring.compare(h, h, ["profile"], "score").where("n = 2999").count() == 3000
