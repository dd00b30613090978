"""Structure, graphs, allocation, grounding, scoring, sources and sinks on small cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import allocation, graphs, grounding, scoring, structure
from corpuscle.plans.packages import _scratch
from corpuscle.sources import files, sinks


def test_blocks_have_running_offsets(spark):
    df = spark.createDataFrame([(1, "# Title\n\nF = ma\n- item\nplain text here")], "doc_id long, text string")
    rows = structure.line_blocks(df).orderBy("ord").collect()
    assert [(r.type, r.level, r.char_start, r.char_end) for r in rows] == [("heading", 1, 0, 7), ("equation", None, 8, 14), ("list", None, 15, 21), ("paragraph", None, 22, 37)]


def stack_parents(levels):
    out, stack = [], []
    for i, level in enumerate(levels):
        open_now = list(stack)
        if level:
            while open_now and levels[open_now[-1]] >= level:
                open_now.pop()
            out.append(tuple(stack))
            stack = [*open_now, i]
        else:
            out.append(tuple(stack))
    return out


def test_open_headings_equal_a_stack(spark):
    rng = random.Random(2)
    docs = {d: [rng.choice([None, None, 1, 2, 3, 4]) for _ in range(40)] for d in range(5)}
    df = spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc int, ord int, level int")
    got = {}
    for r in structure.open_headings(df, "doc", "ord").collect():
        got[r.doc, r.ord] = tuple(r[f"h{k}"] for k in range(1, 7) if r[f"h{k}"] is not None)
    for d, xs in docs.items():
        for i, want in enumerate(stack_parents(xs)):
            assert got[d, i] == want


def brute_spans(sizes, sections, atoms, target):
    """Block by block: what a chunk holds so far decides whether the next one joins it."""
    tokens = lambda n: max(1, n // 4)
    out, open_, chars = [], [], 0
    for i, n in enumerate(sizes):
        if open_ and (sections[i] or tokens(chars) + tokens(n) > target):
            out.append((open_[0], i))
            open_, chars = [], 0
        open_.append(i)
        chars += n + 1
        if atoms[i] and tokens(chars) >= target:
            out.append((open_[0], i + 1))
            open_, chars = [], 0
    return out + ([(open_[0], len(sizes))] if open_ else [])


def test_chunk_spans_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        n, target = rng.randint(0, 40), rng.choice([1, 5, 20, 60])
        sizes = [rng.choice([1, 3, 9, 30, 120, 400]) for _ in range(n)]
        sections, atoms = [rng.random() < 0.1 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        assert structure.chunk_spans(np.array(sizes, dtype=np.int64), np.array(sections, dtype=bool), np.array(atoms, dtype=bool), target) == brute_spans(sizes, sections, atoms, target)


def test_chunk_texts_carry_their_overlap():
    long = " ".join(["word"] * 300)
    out = structure.chunk_texts([long, long, "Section", long, "  ", "Part"], ["paragraph", "paragraph", "heading", "paragraph", "paragraph", "heading"], [None, None, 1, None, None, 3], target=400)
    assert [(c["first_block"], c["last_block"]) for c in out] == [(0, 0), (1, 1), (2, 5)]
    assert 0 < out[1]["carried"] <= 480 and out[2]["carried"] == 0 and out[0]["carried"] == 0
    assert structure.chunk_texts([], [], []) == [] and structure.overlap_tail("short") == "" and structure.overlap_tail("") == ""
    assert out[0]["text"].endswith(structure.overlap_tail(long + "\n")) and out[1]["text"] == structure.overlap_tail(long + "\n") + "\n" + long
    assert [c["section_path"] for c in out] == [[], [], ["Section"]]
    again = structure.chunk_texts(["A", "b " * 900, "C", "d " * 900, "e " * 900], ["heading", "paragraph", "heading", "paragraph", "paragraph"], [1, None, 3, None, None], target=400)
    assert [(c["first_block"], c["section_path"]) for c in again] == [(0, ["A"]), (1, ["A"]), (2, ["A", "C"]), (3, ["A", "C"]), (4, ["A", "C"])]


def test_seams_and_tables_and_pages(spark):
    df = spark.createDataFrame([("abc def", "xx abc"), ("abc", "zzz"), ("", "a"), ("aa", "aaa")], "t string, b string")
    assert [r.n for r in df.select(structure.seam_length(F.col("t"), F.col("b")).alias("n")).collect()] == [3, 0, 0, 2]
    t = spark.createDataFrame([([["h1", "h2"], ["a"], ["b", None, "c"]],)], "rows array<array<string>>")
    assert t.select(structure.normalise_table(F.col("rows")).alias("r")).first().r == [["h1", "h2"], ["a", ""], ["b", ""]]
    f = spark.createDataFrame([(1, 0, 10.04, "aaaa"), (1, 1, 12.0, "bbbbbb"), (1, 2, 10.0, "cc"), (2, 0, 9.0, "x"), (2, 1, 8.0, "y")], "doc_id int, ord int, size double, text string")
    assert {r.doc_id: r.body_size for r in structure.body_font(f).collect()} == {1: 10.0, 2: 9.0}
    pages = spark.createDataFrame([(1, 1, "dense", 80, 90.0, 0.9), (1, 2, None, 80, 90.0, 0.9), (1, 3, None, 10, 90.0, 0.2), (1, 4, None, 50, 2.0, 0.9), (1, 5, None, 0, 0.0, 1.0)], "doc_id int, page int, kind string, chars int, area double, image_share double")
    assert sorted(r.page for r in structure.scanned_pages(pages).collect()) == [1, 5]
    b = spark.createDataFrame([(1, i, "heading" if i % 2 else "paragraph", f"t{i} " + "x" * 50) for i in range(100)], "doc_id int, ord int, type string, text string")
    got = structure.document_sample(b, headings=3, chars=100).first()
    assert [h[:3] for h in got.headings] == ["t1 ", "t3 ", "t5 "] and got.sample.startswith("t0 ") and len(got.sample) == 105


EDGES = "package_id int, ord int, from_id string, to_id string, relation string, confidence double"


def edges(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], EDGES)


def test_edge_cleaning(spark):
    concepts = spark.createDataFrame([(1, c) for c in "abc"], "package_id int, concept_id string")
    got = graphs.clean_edges(edges(spark, [("a", "a", None, 1.0), ("a", "b", "odd", 7.0), ("a", "b", "prerequisite_of", 0.1), ("a", "z", None, 1.0), ("b", "a", "contrasts_with", None)]), concepts).orderBy("ord").collect()
    assert [(r.from_id, r.to_id, r.relation, r.confidence) for r in got] == [("a", "b", "prerequisite_of", 1.0), ("b", "a", "contrasts_with", 1.0)]


def test_cycles(spark):
    rows = [("a", "b", "prerequisite_of", 0.9), ("b", "c", "prerequisite_of", 0.3), ("c", "a", "prerequisite_of", 0.8), ("c", "d", "prerequisite_of", 0.1), ("d", "c", "contrasts_with", 0.0)]
    fixed = graphs.break_cycles(edges(spark, rows))
    assert [(r.from_id, r.to_id) for r in fixed.where("dropped").collect()] == [("b", "c")]
    cyclic = graphs.cyclic_edges(edges(spark, rows[:4]), _scratch)
    assert {(r.from_id, r.to_id) for r in cyclic.collect()} == {("a", "b"), ("b", "c"), ("c", "a")}


def test_long_chains_have_no_round_limit(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}", "prerequisite_of", 1.0) for i in range(110)]
    assert graphs.cyclic_edges(edges(spark, chain), _scratch).count() == 0
    reach = {r.concept_id: r.reach for r in graphs.downstream(edges(spark, chain[:36]), _scratch).collect()}
    assert reach == {f"n{i:03}": 36 - i for i in range(36)}


def test_topological_order_and_reach(spark):
    nodes = spark.createDataFrame([(1, c, i) for i, c in enumerate("dcbaxy")], "package_id int, concept_id string, rank int")
    e = edges(spark, [("a", "b", "p", 1.0), ("b", "c", "p", 1.0), ("a", "d", "p", 1.0), ("x", "y", "p", 1.0), ("y", "x", "p", 1.0)])
    got = graphs.topological_order(nodes, e.select("package_id", "from_id", "to_id")).orderBy("position").collect()
    assert [r.concept_id for r in got] == ["a", "d", "b", "c", "x", "y"]
    reach = {r.concept_id: r.reach for r in graphs.downstream(e, _scratch).collect()}
    assert reach == {"a": 3, "b": 1, "x": 1, "y": 1}


def test_bands_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        loads = rng.integers(1, 9, rng.integers(1, 9)).astype(float)
        count = int(rng.integers(1, 6))
        starts = allocation.cut_points(loads, count)
        k = min(count, len(loads))
        assert len(starts) == k and starts[0] == 0 and starts == sorted(set(starts))
        heaviest = lambda s: max(loads[a:b].sum() for a, b in itertools.pairwise([*s, len(loads)]))  # noqa: B023, E731
        assert heaviest(starts) == min(heaviest([0, *c]) for c in itertools.combinations(range(1, len(loads)), k - 1))


def test_apportion_and_turns(spark):
    df = spark.createDataFrame([("p", i, w, 10) for i, w in enumerate([1, 1, 1])] + [("q", 0, 0, 5)], "g string, i int, weight int, total int")
    assert [r.part for r in allocation.apportion(df, ["g"], ["i"]).orderBy("g", "i").collect()] == [4, 3, 3, 1]
    kinds = spark.createDataFrame([("p", "mcq", 1), ("p", "long", 3), ("p", "short", 1), ("p", "none", 0)], "g string, kind string, count int")
    assert [r.kind for r in allocation.round_robin(kinds, ["g"]).orderBy("position").collect()] == ["long", "mcq", "short", "long", "long"]


def test_periods_and_marks(spark):
    row = spark.createDataFrame([(3.0, 40, 4)], "load double, minutes int, n int")
    count = lambda load, n: row.select(allocation.period_count(F.lit(load), F.lit(40), F.lit(n)).alias("x")).first().x
    assert [count(3.0, 4), count(100.0, 60), count(100.0, 3), count(0.0, 0)] == [1, 20, 3, 1]
    marks = lambda kind, scale: row.select(allocation.marks_of(F.lit(kind), F.lit(scale)).alias("x")).first().x
    assert [marks("mcq", 0.1), marks("mcq", 2.5), marks("short_answer", 1.5), marks("odd", 1.0)] == [1, 2, 4, 2]


def test_grounding(spark):
    chunks = grounding.tokenised(spark.createDataFrame([("c1", "Force equals mass times acceleration in every frame")], "chunk_id string, text string"), "text", "span")
    said = lambda rows, text: grounding.tokenised(rows, text, "claim")
    evidence = spark.createDataFrame([(1, "c1", "mass times acceleration", 0.9), (2, "c1", "mass", 0.9), (3, "c9", "mass times acceleration", 0.9), (4, "c1", "quantum tunnelling here", 0.9)], "claim_id int, chunk_id string, quote string, confidence double")
    assert {r.claim_id: (r.found, r.kept_confidence) for r in grounding.audit(said(evidence, "quote"), chunks).collect()} == {1: ("verbatim", 0.9), 2: ("short", None), 3: ("unresolved", None), 4: ("missing", None)}
    claims = spark.createDataFrame([(1, "extracted", "force equals mass times acceleration", "c1"), (2, "predicted", "force equals mass times acceleration", "c1"), (3, "extracted", "force never equals mass times acceleration", "c1"), (4, "extracted", "anything", None)], "claim_id int, kind string, text string, chunk_id string")
    got = grounding.prefilter(said(claims, "text"), chunks)
    assert {r.claim_id: r.verdict for r in got.collect()} == {1: "supported", 2: None, 3: None, 4: "unsupported"}
    verdicts = spark.createDataFrame([(3, "unsupported")], "claim_id int, judged string")
    done = grounding.judged(got, verdicts)
    assert {r.claim_id: (r.verdict, r.degraded) for r in done.collect()} == {1: ("supported", False), 2: ("partially_supported", True), 3: ("unsupported", False), 4: ("unsupported", False)}
    assert grounding.score(done.withColumn("p", F.lit(1)), ["p"]).first().grounding_score == pytest.approx(1.5 / 4)
    codes = done.select("claim_id", grounding.issue(F.col("kind"), F.col("verdict")).alias("c"))
    assert {r.claim_id: r.c for r in codes.collect()}[2] == "GROUNDING_LOOSELY_FILED_PREDICTION"


def test_nearest_chunk(spark):
    chunks = spark.createDataFrame([(1, "a b c d e f g"), (2, "c d e f g h i j"), (3, "a b c d e f g"), (4, "short one")], "chunk_id int, text string")
    claims = spark.createDataFrame([(1, "x a b c d e y"), (2, "C d  E f g h i"), (3, "nothing shared with any of them"), (4, "short one"), (5, None)], "claim_id int, text string")
    got = grounding.nearest_chunk(grounding.tokenised(claims, "text", "claim"), grounding.tokenised(chunks, "text", "span"))
    assert {r.claim_id: r.chunk_id for r in got.collect()} == {1: 1, 2: 2, 3: None, 4: 4, 5: None}


def test_ranks_gather_no_group(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, 0.5, 1.5, rng.random(), -rng.random()])) for g in ("a", "b", None) for _ in range(rng.randint(200, 400))] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    by = {g: sorted(x for h, x in rows if h == g and x is not None) for g, _ in rows}
    ranks = scoring.nearest_rank(df, ["g"], "x", 0.9, "p90")
    assert {r.g: r.p90 for r in ranks.collect()} == {g: xs[round(0.9 * (len(xs) - 1))] if xs else None for g, xs in by.items()}
    spread = scoring.distribution(df, ["g"], "x")
    got = {r.g: (r.n, r.median, r.min, r.max, r.p25, r.p75, r.sufficient) for r in spread.collect()}
    assert got == {g: (len(xs), pytest.approx(float(np.median(xs))), xs[0], xs[-1], xs[round(0.25 * (len(xs) - 1))], xs[round(0.75 * (len(xs) - 1))], len(xs) >= 5) for g, xs in by.items() if xs}
    for d in (ranks, spread):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f"{name}(" in plan for name in ("collect_list", "median", "percentile"))


def test_scores_skip_what_was_not_measured(spark):
    m = spark.createDataFrame([("a", 80.0, 1.0, 1.0), ("a", None, 5.0, 1.0), ("a", 40.0, 1.0, 0.5), ("b", None, 1.0, 1.0)], "s string, score double, weight double, confidence double")
    got = {r.s: r for r in scoring.stage_scores(m, ["s"]).collect()}
    assert got["a"].score == pytest.approx((80 + 20) / 1.5) and got["a"].confidence == pytest.approx(0.75 * 2 / 3)
    assert got["b"].score is None and got["b"].confidence == 0


def test_history(spark):
    h = spark.createDataFrame([("p", float(x)) for x in (10, 20, 30, 40, 50)] + [("q", 1.0), ("p", None)], "profile string, score double")
    d = {r.profile: r for r in scoring.distribution(h, ["profile"], "score").collect()}
    assert (d["p"].n, d["p"].median, d["p"].p25, d["p"].p75, d["p"].sufficient) == (5, 30.0, 20.0, 40.0, True) and not d["q"].sufficient


def test_compare_leaves_the_run_itself_out_and_looks_back_so_far(spark):
    import statistics

    rng = random.Random(3)
    runs = [(p, i, float(rng.randrange(40)) if rng.random() > 0.2 else None, i // 2) for p, n in (("p", 60), ("q", 5), ("r", 6), ("s", 1)) for i in range(n)]
    h = spark.createDataFrame(runs, "profile string, run_id long, score double, evaluated_at long")
    for most in (1000, 7):
        got = {(r.profile, r.run_id): r for r in scoring.compare(h.drop("evaluated_at").union(spark.createDataFrame([("p", 999, 20.0), ("z", 999, 1.0)], h.drop("evaluated_at").schema)), h, ["profile"], "score", most).collect()}
        for profile, run, value, _ in [*runs, ("p", 999, 20.0, None), ("z", 999, 1.0, None)]:
            window = sorted((r for r in runs if r[0] == profile), key=lambda r: (-r[3], -r[1]))[:most]
            others = [r for r in window if r[1] != run]
            values = [r[2] for r in others if r[2] is not None]
            r = got[profile, run]
            assert r.n == len(others) and r.median == (pytest.approx(statistics.median(values)) if values else None)
            if len(others) < 5 or value is None or not values:
                assert r.change == "unknown"
            else:
                d = value - statistics.median(values)
                assert r.change == ("regressed" if d <= -5 else "improved" if d >= 5 else "steady")


def test_load_is_transitive_whatever_the_cycles(spark):
    rng = random.Random(9)
    pairs = [(g, rng.randrange(12), rng.randrange(12)) for g in range(6) for _ in range(5 + 4 * g)]
    reach = {}
    for g in range(6):
        follow = {}
        for h, a, b in pairs:
            if h == g and a != b:
                follow.setdefault(a, set()).add(b)
        for start in follow:
            seen, left = set(), [start]
            while left:
                for b in follow.get(left.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        left.append(b)
            reach[g, start] = len(seen - {start})
    df = spark.createDataFrame(pairs, "package_id long, from_id long, to_id long")
    assert {(r.package_id, r.concept_id): r.reach for r in graphs.downstream(df, _scratch).collect()} == reach


def test_short_claims_find_the_smallest_chunk_that_holds_them(spark):
    chunks = spark.createDataFrame([(2, "We know that nuclear fission splits atoms in two."), (1, "Other nuclear fission"), (3, "nuclear fission splits atoms in")], "chunk_id long, text string")
    claims = ["nuclear fission splits atoms", "Nuclear fission", "atoms", "in", "splits nuclear", "", None, "nuclear fission splits atoms in"]
    c = grounding.tokenised(spark.createDataFrame(list(enumerate(claims)), "claim_id long, text string"), "text", "claim")
    got = {r.claim_id: r.chunk_id for r in grounding.nearest_chunk(c, grounding.tokenised(chunks, "text", "span")).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 2, 4: None, 5: None, 6: None, 7: 2}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.md").write_bytes(b"# T")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "e.txt").write_bytes(b"x" * 100)
    got = {r.path.rsplit("/", 1)[1]: r.mime for r in files.read_files(spark, str(tmp_path), 50).collect()}
    assert got == {"a.txt": "text/plain", "b.md": "text/markdown", "c.pdf": "application/pdf", "d.bin": None}
    assert sorted(r.text for r in files.read_texts(spark, str(tmp_path), 50).collect()) == ["# T", "one\ntwo"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text('{"package_id": "a", "unknown": 1,\n "n": 2}')
    (tmp_path / "p" / "two.json").write_text('{"package_id": ')
    rows = files.read_packages(spark, str(tmp_path / "p"), "package_id string, n int").collect()
    assert sorted((r.package_id or "", r._corrupt_record is None) for r in rows) == [("", False), ("a", True)]
    keyed = spark.createDataFrame([("k", 2), ("k", 1), (None, 3), (None, 4)], "key string, at int")
    assert sorted((r.key or "", r.at) for r in files.first_of_key(keyed, "key", "at").collect()) == [("", 3), ("", 4), ("k", 1)]
    dims = files.with_overrides(spark.createDataFrame([("x", 1, 2)], "k string, a int, b int"), spark.createDataFrame([("u", None, 9), ("v", 5, None)], "k string, a int, b int"), "k")
    assert {r.k: (r.a, r.b) for r in dims.collect()} == {"u": (1, 9), "v": (5, 2)}


def test_replayed_answers(spark):
    import hashlib

    key = hashlib.sha256(b"s\nsys\nuser\nschema").hexdigest()[:16]
    requests = spark.createDataFrame([(1, "s", "sys", "user", "schema"), (2, "s", "sys", "other", "schema"), (3, "t", "", "", "")], "request_id int, stage string, system string, user string, schema string")
    recorded = spark.createDataFrame([(key, None, "exact"), (None, "s", "stage")], "key string, stage string, response string")
    assert {r.request_id: (r.response, r.missed) for r in files.replay(requests, recorded).collect()} == {1: ("exact", False), 2: ("stage", False), 3: (None, True)}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"], 0)
    last = sinks.upsert(spark, path, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"], 1)
    assert {r.k: r.v for r in spark.read.parquet(last).collect()} == {1: "a", 2: "c"}
    stages = str(tmp_path / "s")
    sinks.put_stage(spark.createDataFrame([("x", 1), ("y", 2)], "stage string, v int"), stages)
    sinks.put_stage(spark.createDataFrame([("y", 3)], "stage string, v int"), stages)
    assert sorted((r.stage, r.v) for r in spark.read.parquet(stages).collect()) == [("x", 1), ("y", 3)]
    text = sinks.markdown(spark.createDataFrame([(1, 2, "B", "b"), (1, 1, "A", "a")], "d int, o int, t string, b string"), "d", "o", "t", "b").first().markdown
    assert text == "## A\n\na\n\n## B\n\nb"
    lines = sinks.metric_lines(spark.createDataFrame([("n", {"b": "2", "a": "1"}, 3.0), ("m", {}, 1.0)], "name string, labels map<string,string>, value double")).collect()
    assert [r.line for r in lines] == ["m 1.0", 'n{a="1",b="2"} 3.0']
    frame = spark.range(1).select(sinks.event_frame(F.lit(3), F.lit("progress"), F.lit("a\nb")).alias("x")).first().x
    assert frame == "id: 3\nevent: progress\ndata: a\ndata: b\n\n"
