"""Assembly of drafts, and hybrid retrieval, on small cases."""

import math
import random
from collections import Counter

import pytest

from corpuscle.operators import assembly, retrieval


def test_activities_say_what_was_derived(spark):
    df = spark.createDataFrame(
        [("p", "a", "role_play", 10, "Part 1", ["inertia"], " T ", [" go ", ""], ["c"], "s", "e"), ("p", "b", "quiz", 3, "Part 1", None, None, None, [" "], None, "e"), (None, None, "quiz", None, None, [], "", [], [], "", "")],
        "package_id string, activity_id string, type string, minutes int, period_title string, names array<string>, title string, steps array<string>, criteria array<string>, support string, extension string")
    a, b, c = assembly.activities(df).orderBy("activity_id", ascending=False).collect()[::-1][1:] + [assembly.activities(df.where("activity_id is null")).first()]
    assert (a.title, a.steps, a.criteria, a.support, a.notes) == ("T", ["go"], ["c"], "s", [])
    assert b.title == "Quiz: Part 1" and len(b.steps) == 3 and "1 minutes" in b.steps[1] and b.extension == "e" and b.notes == ["STEPS_DERIVED", "CRITERIA_DERIVED", "SCAFFOLD_DERIVED"]
    assert c.notes == b.notes and assembly.activities(df.limit(0)).count() == 0


def test_gaps_are_refused_or_repaired(spark):
    d, r = "array<struct<question:string,reveals:string,wrong:string>>", "array<struct<action:string,rationale:string,minutes:int>>"
    asked, acted = [("q", "r", None), (" ", "x", None)], [("do", None, 0), ("", "y", 3)]
    rows = [(1, None, "c", "m", asked, acted), (2, "k", None, " ", asked, acted), (3, None, "c", None, asked, acted), (4, "k", "c", "m", [(" ", None, None)], acted), (5, "k", " fix ", "m", asked, None), (6, "k", " ", "m", asked, []), (7, "k", "c", "m", None, None)]
    got = {x.gap_id: x for x in assembly.gaps(spark.createDataFrame([("p", *x) for x in rows], f"package_id string, gap_id int, known string, correction string, misconception string, diagnostics {d}, remediation {r}")).collect()}
    assert {k: v.refused for k, v in got.items()} == {1: None, 2: None, 3: "NO_MISCONCEPTION", 4: "NO_DIAGNOSTIC", 5: None, 6: "NO_REMEDIATION", 7: "NO_DIAGNOSTIC"}
    assert [tuple(x) for x in got[1].remediation] == [("do", "Answers: m", None)] and [tuple(x) for x in got[1].diagnostics] == [("q", "r", None)] and got[2].misconception == "k"
    assert got[5].notes == ["CORRECTION_USED"] and got[5].remediation[0].action == "fix" and got[3].remediation is None and got[3].notes == []


def test_constructed_items_get_a_ladder(spark):
    level = "array<struct<label:string,descriptor:string,marks:int>>"
    good = [("a", "d", 4), ("b", "e", 1)]
    rows = [(1, "numerical", 6, " s ", "x", "w", None, good), (2, "numerical", 6, "s", "x", " ", "c", None), (3, "long_answer", 3, "s", "x", None, None, [("a", "d", 2), ("b", " ", 1)]), (4, "long_answer", 3, "s", "x", None, None, good), (5, "long_answer", 3, "s", None, None, None, good), (6, "long_answer", 2, "s", "x", None, None, [("a", "d", 1), ("b", "e", 1)])]
    got = {x.item_id: x for x in assembly.constructed_items(spark.createDataFrame([("p", *x) for x in rows], f"package_id string, item_id int, kind string, marks int, stem string, answer string, working string, criteria string, levels {level}")).collect()}
    assert {k: v.notes for k, v in got.items()} == {1: [], 2: ["LADDER_FOR_NONE", "NO_WORKING"], 3: ["LADDER_FOR_EQUAL"], 4: ["LADDER_FOR_EXCESS"], 5: [], 6: ["LADDER_FOR_EQUAL"]}
    assert [tuple(v) for v in got[1].levels] == good and [v.marks for v in got[2].levels] == [6, 4, 3, 2] and got[5].refused == "NO_TEXT" and got[5].levels is None and got[2].criteria == "c"


def test_hybrid_retrieval_equals_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 12))]) for i in range(60)] + [(900, None)]
    queries = [(i, [rng.choice("abcdefghz") * 2 for _ in range(rng.randrange(0, 5))]) for i in range(7)]
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(901, [0.0] * 4), (902, [1.0]), (903, None)]
    held = [(i, t) for i, t in docs if t]
    mean, df = sum(len(t) for _, t in held) / len(held), Counter(w for _, t in held for w in set(t))
    lexical, near = {}, {}
    for q, terms in queries:
        scores = {}
        for i, t in held:
            for w in set(terms):
                if w in t:
                    tf = t.count(w)
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        lexical[q] = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:20]
        a = dict(vectors)[q]
        cos = {i: sum(x * y for x, y in zip(a, v, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in v)) for i, v in vectors if v and len(v) == 4 and any(v)}
        near[q] = sorted(cos, key=lambda i: (-round(cos[i], 9), i))[:20]
    one = retrieval.lexical_ranks(spark.createDataFrame(docs, "id long, tokens array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>"), 20)
    v = spark.createDataFrame(vectors, "id long, v array<double>")
    two = retrieval.vector_ranks(v, v.where("id < 7").withColumnRenamed("id", "query_id"), 20)
    got = {}
    for name, frame in (("one", one), ("two", two)):
        for r in frame.orderBy("rank").collect():
            got.setdefault((name, r.query_id), []).append(r.id)
    assert {q: got.get(("one", q), []) for q, _ in queries} == lexical and {q: got["two", q] for q, _ in queries} == near
    best = {}
    for r in retrieval.fused([one, two], 5).orderBy("rank").collect():
        best.setdefault(r.query_id, []).append(r.id)
    for q, _ in queries:
        total = Counter()
        for ranking in (lexical[q], near[q]):
            for k, i in enumerate(ranking, 1):
                total[i] += 1 / (60 + k)
        assert best[q] == sorted(total, key=lambda i: (-round(total[i], 9), i))[:5]
    assert retrieval.lexical_ranks(spark.createDataFrame([], "id long, tokens array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>")).count() == 0
