"""Every query of the engine's own operators against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from corpuscle import registry
from corpuscle.session import TABLES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda x: "<null>" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in registry.ORACLES:
        cursor = con.execute(registry.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(names)
        assert shown(rows, df.columns) == shown(cursor.fetchall(), names)
    else:
        assert rows


def test_entry_survives_without_the_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corpuscle", tmp_path / "corpuscle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.split() == [str(len(registry.QUERIES)), "False"], out.stderr


def test_entry_survives_without_the_libraries_of_the_training_operators():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": root})
    assert out.returncode == 0 and out.stdout.strip() == str(len(registry.QUERIES)), out.stderr


def test_graph_queries_use_all_nodes(spark, sf):
    from corpuscle.plans import packages

    graphs = {}
    for r in packages._edges(spark, sf).collect():
        graphs.setdefault(r.package_id, set()).update({(r.from_id, r.to_id)} if r.from_id != r.to_id else set())
    want = {}
    for p, pairs in graphs.items():
        left, before = pairs, None
        while left != before:
            before = left
            left = {(a, b) for a, b in left if a in {y for _, y in left} and b in {x for x, _ in left}}
        want[p] = len(left)
    assert {r.package_id: r.n_edges for r in packages.cycle_edges(spark, sf).collect()} == {p: n for p, n in want.items() if n}
    assert {r.package_id: r.n_edges for r in packages.broken_cycles(spark, sf).collect()} == {p: len(x) for p, x in graphs.items() if x}
    nodes = {(r.package_id, c) for r in packages._edges(spark, sf).collect() for c in (r.from_id, r.to_id)}
    assert any(c % 10 == 3 for _, c in nodes)
    assert {(r.package_id, r.concept_id) for r in packages.topo_levels(spark, sf).collect()} == nodes


def test_turns_under_the_threshold_are_distinct(spark, sf, monkeypatch):
    from corpuscle.plans import documents

    words = [f"w{i}" for i in range(20)]
    turns = [(1, 0, words), (1, 1, words[:15]), (2, 0, words), (2, 1, words[:18])]  # similarities 0.75 and 0.9
    df = spark.createDataFrame([(c, t, " ".join(w)) for c, t, w in turns], "conv_id long, turn long, text string")
    monkeypatch.setattr(documents, "table", lambda *_: df)
    assert {r.conv_id: r.distinct_ratio for r in documents.near_dup_ratio(spark, sf).collect()} == {1: 1.0, 2: 0.5}
