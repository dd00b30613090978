"""Planning, packing, lexicon and source functions against plain Python or small cases."""

import random
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from corpuscle.functions import lexicon as L
from corpuscle.functions import text as T
from corpuscle.operators import allocation as A
from corpuscle.operators import graphs, structure
from corpuscle.operators import packages as P
from corpuscle.sources import files, sinks


def test_whole_minutes():
    rng = random.Random(1)
    for _ in range(300):
        raw = np.array([rng.random() * 20 for _ in range(rng.randint(1, 8))])
        total = rng.choice([int(raw.sum()), 3, 40])
        got = A.whole_minutes(raw, total)
        want = [max(1, int(x)) for x in raw]
        order, k = sorted(range(len(raw)), key=lambda i: (-(raw[i] - int(raw[i])), i)), 0
        while sum(want) < max(total, len(raw)):
            want[order[k % len(raw)]] += 1
            k += 1
        while sum(want) > max(total, len(raw)):
            want[want.index(max(want))] -= 1
        assert got.tolist() == want and min(got) >= 1


def test_time_slots_and_activities(spark):
    p = spark.createDataFrame([(1, 1, 4, [10.0, 40.0, 10.0], 40), (1, 2, 1, [None, 0.0], 40), (1, 3, 5, [1.0] * 6, 4), (2, 1, 1, None, 30)], "package_id int, period_no int, n_concepts int, minutes array<double>, duration int")
    slots = A.time_slots(p)
    got = {(r.package_id, r.period_no): r.slots for r in slots.collect()}
    assert got[1, 1] == [7, 27, 6] and got[1, 3] == [1] * 4 and sum(got[1, 2]) == 40 and len(got[1, 2]) == len(A.ARC) and sum(got[2, 1]) == 30
    acts = sorted(tuple(r) for r in A.activity_slots(slots, ["game", "talk"]).collect())
    assert acts == [(1, 1, "act_p1_1", "game", 13), (1, 1, "act_p1_2", "talk", 13), (1, 2, "act_p2_1", "game", 12), (1, 3, "act_p3_1", "talk", 8), (2, 1, "act_p1_1", "game", 9)]


def test_objective_bands(spark):
    o = spark.createDataFrame([(1, "o1", ["a", "b"], ["x"]), (1, "o2", ["zz"], ["laws", "of", "motion"]), (1, "o3", [], ["nothing"])], "package_id int, objective_id string, concept_ids array<string>, tokens array<string>")
    b = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 3), (1, "d", 5)], "package_id int, concept_id string, band int")
    n = spark.createDataFrame([(1, "c", ["motion", "laws"]), (1, "d", ["motion"])], "package_id int, concept_id string, tokens array<string>")
    assert sorted((r.band, r.objective_id) for r in A.objective_bands(o, b, n).collect()) == [(0, "o1"), (1, "o1"), (3, "o2"), (5, "o2")]


def test_blueprint(spark):
    mix = spark.createDataFrame([(1, 8, {"mcq": 0.5, "long_answer": 0.25, "numerical": 0.0}, {"mcq": 2.0, "essay": 9.0}), (2, 3, {}, {})], "package_id int, budget int, mix map<string,double>, emphasis map<string,double>")
    board = {r.package_id: r.b for r in mix.select("package_id", A.blended(F.col("mix"), F.col("emphasis")).alias("b")).collect()}
    assert board[1] == {"mcq": 0.8, "long_answer": 0.2, "numerical": 0.0} and board[2] == {}
    plan = A.kind_plan(mix)
    kinds = {}
    for r in plan.orderBy("package_id", "position").collect():
        kinds.setdefault(r.package_id, []).append(r.kind)
    assert kinds == {1: ["mcq", "long_answer", "mcq", "long_answer", "mcq", "mcq"], 2: ["short_answer"] * 3}
    o = spark.createDataFrame([(1, 0, "o1", "evaluate", [7, 99]), (1, 1, "o2", None, [])], "package_id int, ord int, objective_id string, bloom string, concept_ids array<int>")
    c = spark.createDataFrame([(1, 7, 0), (1, 8, 1), (2, 9, 0)], "package_id int, concept_id int, ord int")
    items = {(r.package_id, r.item_id): (r.kind, r.marks, r.bloom, r.objective_id, r.concept_ids) for r in A.blueprint(plan, A.coverage_targets(o, c)).collect()}
    assert items[1, "item_01"] == ("mcq", 1, "apply", "o1", [7]) and items[1, "item_02"] == ("long_answer", 6, "understand", "o2", []) and items[1, "item_03"] == ("mcq", 1, "understand", None, [8])
    assert items[1, "item_04"][2:4] == ("evaluate", "o1") and len(items) == 9


def test_options_and_rubrics_and_windows(spark):
    q = spark.createDataFrame([(1, [("A ", False, "x"), ("a", True, "y"), ("b", False, None), (" ", True, None)]), (2, [("a", True, None), ("A", True, None)]), (3, [("a", True, None), ("b", True, None)])], "id int, o array<struct<text:string,is_correct:boolean,why:string>>")
    got = {r.id: r.x for r in q.select("id", A.rebuilt_options(F.col("o")).alias("x")).collect()}
    assert [tuple(o) for o in got[1]] == [("A", True, "x"), ("b", False, None)] and got[2] is None and got[3] is None
    assert [r[0] for r in spark.createDataFrame([(8,), (3,), (1,)], "m int").select(A.rubric_ladder(F.col("m"))).collect()] == [[8, 6, 4, 2], [3, 2, 1], [1, 0]]
    s = spark.createDataFrame([(1, 1, i, 5, 20) for i in range(12)] + [(1, 2, 0, 0, 20)], "package_id int, period_no int, ord int, minutes int, duration int")
    w = sorted((r.ord, r.start, r.stop) for r in A.script_windows(s).collect())
    assert len(w) == 10 and w[0] == (0, 0, 2) and w[-1] == (9, 18, 20) and all(a[2] == b[1] for a, b in zip(w, w[1:], strict=False))


def test_cycles_enter_the_last_follower_first(spark):
    # From a the search enters c (its last follower), whose follower a is open: a-c, not a-b, is found first.
    assert graphs._cycle({"a": ["b", "c"], "b": ["a"], "c": ["a"]}) == [("a", "c"), ("c", "a")]
    assert graphs._cycle({"a": ["b"], "b": ["c"], "c": []}) is None
    rng = random.Random(4)
    for _ in range(200):
        follow = {i: [rng.randrange(8) for _ in range(rng.randint(0, 2))] for i in range(8)}
        loop = graphs._cycle(follow)
        left = {(a, b) for a, bs in follow.items() for b in bs}
        while True:
            kept = {(a, b) for a, b in left if any(c == b for c, _ in left)}
            if kept == left:
                break
            left = kept
        assert (loop is None) == (not left)
        if loop:
            assert all(b in follow[a] for a, b in loop) and [b for _, b in loop] == [a for a, _ in loop[1:]] + [loop[0][0]]


def test_gap_seeds(spark):
    c = spark.createDataFrame([(1, x, i) for x, i in (("a", "core"), ("b", "supporting"), ("c", "supporting"), ("d", "core"), ("e", None))], "package_id int, concept_id string, importance string")
    m = spark.createDataFrame([(1, 0, "b"), (1, 3, "zz")], "package_id int, ord int, concept_id string")
    reach = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 1)], "package_id int, concept_id string, reach long")
    got = sorted((r.gap_id, r.concept_ids, r.severity, r.observed) for r in graphs.gap_seeds(c, m, reach, 2).collect())
    assert got == [(1, ["b"], "high", True), (2, ["zz"], "low", True), (3, ["a"], "high", False), (4, ["c"], "medium", False)]


def test_budget_runs_and_choices(spark):
    rng = random.Random(2)
    for _ in range(200):
        sizes, budget = [rng.randint(1, 9) for _ in range(rng.randint(0, 20))], rng.randint(1, 15)
        want, held = [], []
        for i, n in enumerate(sizes):
            if held and sum(sizes[k] for k in held) + n > budget:
                want.append((held[0], i))
                held = []
            held.append(i)
        want += [(held[0], len(sizes))] if held else []
        assert structure.budget_runs(np.array(sizes, dtype=np.int64), budget) == want
    passes = structure.section_passes(np.array([4, 4, 9, 2, 4]), ["A", None, "B", "A", None], 7, False)
    assert passes.tolist() == [0, 1, 3, 0, 2] or passes[0] == passes[3]
    assert structure.context_choice(np.array([5, 5, 5, 5, 5]), np.array([0, 2, 0, 3, 0]), 14).tolist() == [False, True, False, True, False]
    assert structure.context_choice(np.array([2] * 6), np.zeros(6, dtype=int), 6).tolist() == [True, False, True, False, True, False]
    rows = spark.createDataFrame([(1, i, 3, ["S"] if i < 2 else [], i % 2) for i in range(5)], "doc_id int, ordinal int, token_count int, section_path array<string>, weight int")
    assert sorted((r.ordinal, r["pass"]) for r in structure.extraction_passes(rows, 6).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    assert sorted(r.ordinal for r in structure.context_chunks(rows, 9).collect()) == [0, 1, 3]


def test_lexicon_equals_plain_python(spark):
    texts = [
        "Ask the class to sketch the photoelectric effect.", "Take a moment to engage the students.", "Write 12 N on the board", "Students will be able to explain the photoelectric effect", "Understands inertia",
        "states the law of inertia clearly", "An excellent response overall", "", "Give extra help", "more practice with inertia, and more practice with the photoelectric effect again", "calculate", "Correct method, wrong units", "use the word bank",
    ]
    vocabulary = ["photoelectric effect", "inertia", "law"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string").withColumn("v", L.words(vocabulary)).withColumn("n", T.simple_normalise(F.col("raw"))).withColumn("k", T.word_tokens(F.col("n")))
    n, k, v = F.col("n"), F.col("k"), F.col("v")
    got = {r.id: r for r in rows.select(
        "id", L.has_imperative(n).alias("imperative"), L.is_generic_script(n).alias("generic"), L.mentions_vocabulary(k, v).alias("mentions"), L.has_concrete_anchor(F.col("raw"), k, v).alias("anchor"),
        L.criterion_is_observable(n, k).alias("observable"), L.specificity(F.col("raw"), n, k, v).alias("specificity"), F.array_sort(L.content_words(k)).alias("content"), L.effective_verb(n).alias("verb"), L.is_padded(n).alias("padded"),
        L.restates_a_concept(n, F.array(F.split(F.lit("photoelectric effect"), " "))).alias("restates"), L.note_is_actionable(n, k, v).alias("actionable")).collect()}
    noise = {*L.FUNCTION_WORDS, *L.EVALUATIVE_MARKERS, *(m for m in L.UNOBSERVABLE_MARKERS if " " not in m)}
    for i, raw in enumerate(texts):
        norm = " ".join(raw.lower().split())
        tokens = re.findall(T.WORD_TOKEN, norm)
        mentions = any(t in " ".join(tokens) if " " in t else t in tokens for t in vocabulary)
        anchor = mentions or bool(re.search(L.QUANTITY, raw)) or bool(re.search(L.FRAME, raw))
        firsts = [(re.findall(T.WORD_TOKEN, s) or [""])[0] for s in re.split(T.SENTENCE_END, norm) if s.strip()]
        imperative = any(f in L.IMPERATIVES for f in firsts)
        generic = any(m in norm for m in L.GENERIC_SCRIPT)
        mind = any(m in norm if " " in m else m in tokens for m in L.UNOBSERVABLE_MARKERS)
        observable = 1.0 if set(tokens) & set(L.OBSERVABLE_VERBS) else 0.0 if mind else None
        vague = any(m in norm for m in L.GENERIC_DIFFERENTIATION)
        specific = max(0.0, 1 - 0.4 * (len(tokens) < 6) - (0.5 if vague and not anchor else 0.15 if vague else 0) - 0.25 * (not anchor))
        content = {re.sub("(?:'s|s)$", "", t) if len(t) > 3 else t for t in tokens if len(t) >= 3 and t not in noise and not t.isdigit()}
        bare = re.sub(L.PADDING, "", norm)
        verb = (re.findall(T.WORD_TOKEN, bare) or [""])[0]
        r = got[i]
        assert (r.imperative, r.generic, r.mentions, r.anchor, r.observable, set(r.content), r.verb, r.actionable) == (imperative, generic, mentions, anchor, observable, content, verb, imperative and not generic and mentions), raw
        assert abs(r.specificity - specific) < 1e-9, raw
    assert got[3].padded and not got[0].padded and got[3].restates and got[10].restates and not got[5].restates


def test_small_text_functions(spark):
    one = spark.createDataFrame([(1,)], "x int")
    value = lambda c: one.select(c.alias("y")).first().y
    lit = F.lit
    assert value(L.as_label(lit("Guided practice: students calculate the forces"))) == "Guided practice" and value(L.as_label(lit("one two three four five six seven, eight"))) == "one two three four five six" and value(L.as_label(lit("  "))) == ""
    assert value(L.to_latex(lit("E = m×c²"))) == "E = m \\times c^{2}" and value(L.to_latex(lit("$x_1$"))) == "x_1" and value(L.to_latex(lit("\\frac{a}{b}"))) == "\\frac{a}{b}" and value(L.to_latex(lit("plain words here"))) is None
    assert value(L.to_latex(lit("v₁₂ = α"))) == "v_{12} = \\alpha"
    assert value(L.strip_fences(lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and value(L.extract_json(lit('well: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}' and value(L.extract_json(lit("none"))) is None
    assert value(L.escaped_block(lit("a</document>b"))) == "<document>\na&lt;/document>b\n</document>" and value(L.has_devanagari(lit("x ऊर्जा"))) and not value(L.has_devanagari(lit("abc")))
    assert value(L.sample_id(lit("physics"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "physics"))
    assert value(L.first_filled(lit(None).cast("string"), lit(" "), lit("t"))) == "t"
    assert tuple(one.select(*L.last_numbers(lit("Limit 8000, Used: 7,900, used 42"))).first()) == (8000, 42, None)
    assert [value(L.retry_seconds(lit(h).cast("string"), lit(m))) for h, m in ((None, "try again in 2m7.5s"), ("3", "2m"), (None, "in 9s"), (None, "soon"))] == [127.5, 3.0, 9.0, None]
    d = lambda *xs: value(L.descriptor_discrimination(F.array(*[F.array(*[lit(w) for w in x]) if x else F.array().cast("array<string>") for x in xs])))
    assert d(["method"], ["method"]) == 0.5 and d(["unit"], ["method", "unit"]) == 1.0 and d(["a"]) == 0.0 and d([], ["b"], ["b"]) == (2 / 3 + 1 / 2) / 2
    assert value(L.bloom_distance(lit("create"), lit("remember"))) == 5 and value(L.bloom_distance(lit("odd"), lit("apply"))) == 0 and value(L.capped_bloom(lit("create"))) == "apply" and value(L.bloom_of(lit("rank"))) == "evaluate"
    assert sorted(value(L.vocabulary_terms(lit("the photoelectric effect")))) == ["effect", "photoelectric", "the photoelectric effect"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("na\xefve\r\nx".encode("latin-1"))
    (tmp_path / "b.md").write_text("# é\nok")
    (tmp_path / "c.bin").write_bytes(b"\xff\x00")
    (tmp_path / "d.txt").write_text("long " * 100)
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in files.read_texts(spark, str(tmp_path), 100).collect()}
    assert texts == {"a.txt": "naïve\nx", "b.md": "# é\nok"}
    assert [r.path.rsplit("/", 1)[-1] for r in files.rejected_files(spark, str(tmp_path), 100).collect()] == ["d.txt"]
    listing = spark.createDataFrame([("ok", "m", 10, 5), ("tight", "m", 2 << 20, 100), ("big", "m", 150 << 20, 150 << 20), ("big", "n", 60 << 20, 60 << 20)], "path string, name string, size long, compressed long")
    assert {r.path: r.reason for r in files.archive_verdicts(listing).collect()} == {"ok": None, "tight": "ratio", "big": "size"}
    kinds = spark.createDataFrame([("text/markdown",), ("image/png",)], "m string").select(files.parser_of(F.col("m")).alias("p"))
    assert [r.p for r in kinds.collect()] == ["text", None]
    held = spark.createDataFrame([("r", "s1"), ("r", "s2"), ("r", "s3"), ("q", "s3")], "run_id string, stage string")
    assert sorted(tuple(r) for r in sinks.without_stages(held, "r", ["s1", "s2", "s3"], "s2").collect()) == [("q", "s3"), ("r", "s1")]
    report = sinks.report_lines(spark.createDataFrame([(1, "b", 50.0, 1.0), (1, "a", None, 0.0)], "package_id int, stage string, score double, confidence double")).first().markdown
    assert report.splitlines()[-2:] == ["| a | n/a | 0.0 |", "| b | 50.0 | 1.0 |"]


def test_package_pairs_and_status(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b", "c", "d", "e", "f"]), (1, 2, ["a", "b", "c", "d", "e", "f", "a"]), (1, 3, ["a", "z"]), (2, 1, ["a", "b"]), (1, 4, [])], "package_id int, k int, t array<string>")
    assert [(r.package_id, r.a, r.b, r.similarity) for r in P.duplicate_pairs(rows, "k", "t").collect()] == [(1, 1, 2, 1.0)]
    issues = spark.createDataFrame([(1, "X", "warning", "s", "x"), (2, "Y", "error", "t", "y"), (2, "Z", "error", "a", "z")], "package_id int, code string, severity string, stage string, subject string")
    packages = spark.createDataFrame([(1,), (2,), (3,)], "package_id int")
    assert {r.package_id: (r.owners, r.status) for r in P.status(packages, issues).collect()} == {1: ("", "pass_with_warnings"), 2: ("a,t", "fail"), 3: ("", "pass")}
