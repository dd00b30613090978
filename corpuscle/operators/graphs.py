"""Concept graphs: cleaning, cycles, order, reach."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE = ["package_id", "from_id", "to_id", "relation"]


def clean_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges (package_id, ord, from_id, to_id, relation, confidence) between two different known concepts, the first of each kind.

    Unknown relations count as prerequisite_of, confidences are cut to 0..1, missing ones are 1.
    """
    relation = F.when(F.col("relation").isin("prerequisite_of", "part_of", "contrasts_with"), F.col("relation")).otherwise("prerequisite_of")
    e = edges.withColumn("relation", relation).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))
    e = e.where("from_id <> to_id")
    for end in ("from_id", "to_id"):
        known = concepts.select(F.col("package_id"), F.col("concept_id").alias(end)).distinct()
        e = e.join(known, ["package_id", end], "left_semi")
    return e.groupBy(*EDGE).agg(F.min(F.struct("ord", "confidence")).alias("x")).select(*EDGE, "x.ord", "x.confidence")


def cyclic_edges(edges: DataFrame, materialize) -> DataFrame:
    """Edges (package_id, from_id, to_id) that remain after peeling nodes that nothing precedes or follows: those on or between cycles.

    Every round is two semi-joins over all packages at once; it stops when no edge goes,
    however long the chains are. materialize(df) cuts the lineage.
    """
    left = materialize(edges.select("package_id", "from_id", "to_id").distinct())
    n = left.count()
    while n:
        targets, sources = left.select("package_id", F.col("to_id").alias("from_id")).distinct(), left.select("package_id", F.col("from_id").alias("to_id")).distinct()
        left = materialize(left.join(targets, ["package_id", "from_id"], "left_semi").join(sources, ["package_id", "to_id"], "left_semi"))
        now = left.count()
        if now == n:
            break
        n = now
    return left.select("package_id", "from_id", "to_id")


def _cycle(follow: dict) -> list | None:
    """One cycle as a list of edges, by depth-first search from the nodes in order.

    A node whose followers include one that is open closes a cycle with the first such; else
    its last follower is entered first.
    """
    done: set = set()
    for root in follow:
        path: list = []
        open_: set = set()
        todo = [(root, 0)]
        while todo:
            node, depth = todo.pop()
            if node in done or node in open_:
                continue
            done.update(path[depth:])
            open_.difference_update(path[depth:])
            del path[depth:]
            if node in done:
                continue
            path.append(node)
            open_.add(node)
            ahead = follow.get(node, ())
            closing = next((n for n in ahead if n in open_), None)
            if closing is not None:
                loop = [*path[path.index(closing) :], closing]
                return list(zip(loop, loop[1:], strict=False))
            todo += [(n, depth + 1) for n in ahead]
        done.update(path)
    return None


def _repaired(ends: list, confidence: list) -> list:
    """Which of a graph's edges (from, to; None: not to be touched), in order, go so that no cycle is left."""
    dropped = [False] * len(ends)
    while True:
        follow: dict = {}
        live = [k for k, pair in enumerate(ends) if pair and not dropped[k]]
        for k in live:
            follow.setdefault(ends[k][0], []).append(ends[k][1])
        loop = _cycle(follow)
        if loop is None:
            return dropped
        pairs = set(loop)
        dropped[min((k for k in live if ends[k] in pairs), key=lambda k: confidence[k])] = True


def break_cycles(edges: DataFrame) -> DataFrame:
    """Cleaned edges and `dropped`: of each prerequisite cycle the least confident edge goes, the earliest of equals.

    Which cycle is found first depends on the search, so a package's graph, which is small, is
    repaired as one row, many rows to an Arrow batch; other relations are never touched.
    """

    @F.pandas_udf("array<boolean>")
    def repaired(sources: pd.Series, targets: pd.Series, confidence: pd.Series, live: pd.Series) -> pd.Series:
        return pd.Series([_repaired([(a, b) if on else None for a, b, on in zip(s.tolist(), t.tolist(), l.tolist(), strict=True)], c.tolist()) for s, t, c, l in zip(sources, targets, confidence, live, strict=True)])

    rest = [c for c in edges.columns if c not in ("package_id", "ord")]
    g = edges.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("_e"))
    of = lambda value: F.transform("_e", value)
    dropped = repaired(of(lambda e: e["from_id"]), of(lambda e: e["to_id"]), of(lambda e: e["confidence"]), of(lambda e: e["relation"] == "prerequisite_of"))
    rows = g.select("package_id", "_e", dropped.alias("dropped")).select("package_id", F.inline(F.arrays_zip("_e", "dropped")))
    return rows.select(*[F.col("package_id") if c == "package_id" else F.col(f"_e.{c}") for c in edges.columns], "dropped")


def _ordered(nodes: list, links: list) -> list:
    """Places in nodes, which come by rank: sources first, what a cycle strands last."""
    rank = dict(zip(nodes, range(len(nodes)), strict=True))
    pairs = {(rank[a], rank[b]) for a, b in links if a in rank and b in rank and a != b}
    waits, follow = [0] * len(nodes), [[] for _ in nodes]
    for a, b in pairs:
        waits[b] += 1
        follow[a].append(b)
    ready, out = [i for i, w in enumerate(waits) if not w], []
    heapq.heapify(ready)
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for j in follow[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    return out + sorted(set(range(len(nodes))) - set(out))


def topological_order(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, concept_id, position): prerequisites first, ties by the concept's rank; what a cycle strands comes last by rank.

    concepts (package_id, concept_id, rank) and edges (package_id, from_id, to_id, and relation, of which
    only prerequisite_of counts, if there is one) are gathered by package, whose graph is small and one row of an Arrow batch.
    """
    if "relation" in edges.columns:
        edges = edges.where("relation = 'prerequisite_of'").select("package_id", "from_id", "to_id")

    @F.pandas_udf("array<int>")
    def ordered(nodes: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([_ordered(n.tolist(), list(zip(s.tolist(), t.tolist(), strict=True))) for n, s, t in zip(nodes, sources, targets, strict=True)])

    nodes = concepts.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("rank", "concept_id"))).alias("n"))
    links = edges.groupBy("package_id").agg(F.collect_list(F.struct("from_id", "to_id")).alias("e"))
    end = lambda c: F.coalesce(F.transform("e", lambda x: x[c]), F.array().cast(f"array<{edges.schema[c].dataType.simpleString()}>")).alias(c)
    both = nodes.join(links, "package_id", "left").select("package_id", F.transform("n", lambda x: x["concept_id"]).alias("n"), end("from_id"), end("to_id"))
    placed = both.select("package_id", "n", ordered("n", "from_id", "to_id").alias("o")).select("package_id", F.posexplode(F.transform("o", lambda i: F.get("n", i))).alias("position", "concept_id"))
    return placed.select("package_id", "concept_id", F.col("position").cast("long").alias("position"))


def downstream(edges: DataFrame, materialize) -> DataFrame:
    """(package_id, concept_id, reach): how many other concepts a concept leads to, over any number of steps.

    The closure of all packages at once: each round joins only the pairs that the last one found with those known, which
    doubles the length of the paths, so paths of any length take rounds by its logarithm and no pair is extended twice by
    the same one. (A shortest path of more than n steps begins with one of just n, which the round for n found.) Cycles are no trouble: a concept does not lead to itself.
    """
    known = new = materialize(edges.select("package_id", "from_id", "to_id").where("from_id <> to_id").distinct())
    while True:
        longer = new.select("package_id", "from_id", F.col("to_id").alias("via")).join(known.select("package_id", F.col("from_id").alias("via"), "to_id"), ["package_id", "via"])
        new = materialize(longer.select("package_id", "from_id", "to_id").where("from_id <> to_id").distinct().join(known, ["package_id", "from_id", "to_id"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known.groupBy("package_id", F.col("from_id").alias("concept_id")).agg(F.count("*").alias("reach"))


def severity(reach, importance):
    """high from two dependents on, medium with one or for a core concept, else low."""
    return F.when(reach >= 2, "high").when((reach >= 1) | (importance == "core"), "medium").otherwise("low")


def gap_seeds(concepts: DataFrame, misconceptions: DataFrame, reach: DataFrame, most_predicted: int = 4) -> DataFrame:
    """Which gaps a package has: one observed gap for each misconception, and predicted ones for concepts that carry others and that no misconception names.

    concepts (package_id, concept_id, importance), misconceptions (package_id, ord, concept_id: one of its
    concepts a row), reach (package_id, concept_id, reach). Returns (package_id, gap_id, concept_ids, severity, observed): gap_id
    counts the misconceptions in order, then at most most_predicted concepts with the most dependents first, ties by id.
    """
    known = concepts.join(reach, ["package_id", "concept_id"], "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    named = misconceptions.join(known, ["package_id", "concept_id"], "left")
    seen = named.groupBy("package_id", "ord").agg(F.array_sort(F.collect_list("concept_id")).alias("concept_ids"), F.max(F.coalesce("reach", F.lit(0))).alias("reach"), F.bool_or(F.coalesce(F.col("importance") == "core", F.lit(False))).alias("core"))
    number = F.row_number().over(Window.partitionBy("package_id").orderBy("ord"))
    seen = seen.withColumn("gap_id", number.cast("long")).withColumn("observed", F.lit(True))
    count = seen.groupBy("package_id").agg(F.count("*").alias("n"))
    free = known.join(misconceptions.select("package_id", "concept_id").distinct(), ["package_id", "concept_id"], "left_anti").where("reach >= 1 or importance = 'core'")
    rank = F.row_number().over(Window.partitionBy("package_id").orderBy(F.col("reach").desc(), "concept_id"))
    free = free.withColumn("rank", rank).where(F.col("rank") <= most_predicted).join(count, "package_id", "left")
    free = free.select("package_id", F.array("concept_id").alias("concept_ids"), "reach", F.coalesce(F.col("importance") == "core", F.lit(False)).alias("core"), (F.coalesce("n", F.lit(0)) + F.col("rank")).cast("long").alias("gap_id"), F.lit(False).alias("observed"))
    both = seen.select(free.columns).unionByName(free)
    return both.select("package_id", "gap_id", "concept_ids", severity(F.col("reach"), F.when(F.col("core"), "core")).alias("severity"), "observed")


def top_gaps(gaps: DataFrame, most: int = 10) -> DataFrame:
    """The `most` gravest gaps (package_id, gap_id, severity, observed) of each package, with their rank: observed before predicted, then by id."""
    weight = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    w = Window.partitionBy("package_id").orderBy(weight, F.col("observed").desc(), "gap_id")
    return gaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
