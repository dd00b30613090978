"""Mixing sources to target weights: hierarchical budgeting over a tree of groups, in DataFrame functions only.

Weights go down the tree (say domain, language, source). A group that has fewer tokens than
its share gives the shortage to its siblings; only what they cannot take goes to its parent's
siblings. Each leaf then takes a prefix of a sequence of seeded epochs, each a permutation of
the leaf's documents, whose tokens add up to the leaf's budget.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize

#: The name of a group whose level value is null.
NONE = "(none)"
#: Rows of one id and length that one task puts out.
COPIES = 10_000


def word_tokens(text: Column) -> Column:
    """Words of a text as its token count; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Adds `share` (long) to children (parent keys, order keys, weight, capacity, budget of the parent).

    Shares rise in proportion to the weights until a child is full; what a full child leaves
    goes to the others in proportion to theirs. With the children in the order of
    capacity / weight, child k is full if the budget covers the capacities before it and its
    own ratio for all the weights from it on, so that windows over siblings suffice.
    All is computed in whole numbers: shares are rounded down, and what that leaves goes by
    one to the largest remainders, so that the shares add up to the budget if the capacities allow.
    """
    by = [F.col(c) for c in parent] or [F.lit(0)]
    all_of = Window.partitionBy(*by)
    before = all_of.orderBy("ratio", *order).rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(20,0)")
    c = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    c = c.withColumn("c0", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("w1", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    c = c.withColumn("full", (F.col("weight") > 0) & (wide(F.col("capacity")) * wide(F.col("w1")) <= wide(F.col("budget") - F.col("c0")) * wide(F.col("weight"))))
    c = c.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(all_of)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_of))
    some = F.col("open") > 0
    c = c.withColumn("part", F.when(some & ~F.col("full"), F.expr("(rest % open) * weight")).otherwise(0))
    c = c.withColumn("least", F.when(F.col("full"), F.col("capacity")).when(some, F.expr("rest div open * weight + part div open")).otherwise(0))
    c = c.withColumn("spare", F.col("budget") - F.sum("least").over(all_of))
    turn = F.row_number().over(all_of.orderBy(F.expr("not full and weight > 0").desc(), F.when(some, F.expr("part % open")).desc(), *order))
    share = F.col("least") + F.when(~F.col("full") & (F.col("weight") > 0) & (turn <= F.col("spare")), 1).otherwise(0)
    return c.withColumn("share", F.least(share, F.col("capacity")).cast("long")).drop("ratio", "c0", "w1", "full", "rest", "open", "part", "least", "spare")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, int], budget: Callable[[Column], Column], max_epochs: int) -> DataFrame:
    """Budgets of the leaves (levels, tokens, n_docs): adds capacity and budget.

    weights: whole weights by node path ("web", "web/en", "web/en/src0"); 1 where not given. A
    node of weight 0 takes nothing, so it is no capacity of its parent's either, and what it leaves
    goes to its ancestors' siblings. budget: gives the whole budget for the column of all tokens.
    """
    known = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    tree, below = {}, nodes
    for depth in range(len(levels), 0, -1):
        path = F.concat_ws("/", *levels[:depth])
        below = below.groupBy(*levels[:depth]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        below = below.withColumn("weight", (F.coalesce(known[path], F.lit(1)) if known is not None else F.lit(1)).cast("long"))
        below = below.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
        tree[depth] = below
    whole = Window.partitionBy(F.lit(0))  # the nodes of the first level
    above = tree[1].withColumn("budget", F.least(budget(F.sum("tokens").over(whole)).cast("long"), F.sum("capacity").over(whole)))
    for depth in range(1, len(levels) + 1):
        level = above if depth == 1 else tree[depth].join(above, levels[: depth - 1])
        above = fill(level, levels[: depth - 1], [levels[depth - 1]]).select(*levels[:depth], F.col("share").alias("budget"))
    return nodes.join(above, levels)


def seeded_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The hex string that orders a leaf's documents in an epoch."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix_sources(
    df: DataFrame, levels: dict[str, Column], weights: dict[str, int], fraction: tuple[int, int] = (1, 2), max_epochs: int = 1,
    seed: int = 7, id_col: str = "doc_id", n_tokens: Column | None = None,
) -> DataFrame:
    """One row per taken document and epoch: id_col, the levels, epoch, n_tokens, take_tokens.

    levels: names and expressions from the root down. The budget is fraction[0]/fraction[1] of
    all tokens. take_tokens is n_tokens but for the last document of a leaf, whose prefix
    fills the budget. A leaf's epochs are ordered by md5 of seed, epoch and id, then by id and
    tokens; a leaf is repeated at most max_epochs times.

    Null level values form a group "(none)". Documents without tokens (null, empty or blank
    text) are never taken. Repeated rows count as rows of their own. Null ids are ordered
    as the text "null". Extra columns are ignored; an empty input gives an empty result.
    """
    names = list(levels)
    tokens = word_tokens(F.col("text")) if n_tokens is None else n_tokens
    docs = df.select(F.col(id_col).cast("long").alias("id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()], tokens.cast("long").alias("n_tokens")).where("n_tokens > 0")
    docs = materialize(docs, "tokens")
    leaves = docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    # Equals floor(tokens * n / d) without its overflow.
    n, d = fraction
    share = lambda total: F.floor(total / d) * n + F.floor(total % d * n / d)
    leaves = leaf_budgets(leaves, names, weights, share, max_epochs)
    leaves = leaves.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    # A leaf may hold a third of all rows: its prefix sum is taken over about sqrt(n) ranges of the order, then inside each.
    leaves = materialize(leaves.select(*names, "epochs", "rest", F.ceil(F.sqrt("n_docs")).cast("long").alias("ranges")), "leaves")

    whole = docs.join(leaves.where("epochs > 0").select(*names, "epochs"), names).withColumn("epoch", F.explode(F.expr("sequence(0, epochs - 1)"))).select("id", *names, "epoch", "n_tokens", F.col("n_tokens").alias("take_tokens"))

    # Rows of one id and length are alike: they are counted first, so that one id (or null) of very many rows is no hot range.
    alike = docs.groupBy(*names, "id", "n_tokens").agg(F.count("*").alias("copies"))
    some = alike.join(leaves.where("rest > 0"), names).withColumn("order", seeded_order(seed, F.col("epochs"), F.col("id")))
    some = some.withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("ranges") / 2**32)).withColumn("sum", F.col("n_tokens") * F.col("copies"))
    here = Window.partitionBy(*names, "range").orderBy("order", F.col("id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy(*names, "range").agg(F.sum("sum").alias("t")).select(*names, "range", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("start"))
    part = some.withColumn("inside", F.sum("sum").over(here) - F.col("sum")).join(starts, [*names, "range"])
    part = part.withColumn("left", F.col("rest") - F.col("start") - F.col("inside")).where("left > 0")
    part = part.withColumn("taken", F.least("copies", F.ceil(F.col("left") / F.col("n_tokens"))).cast("long"))
    few = part.where(F.col("taken") <= COPIES).withColumn("from", F.lit(0).cast("long"))
    many = part.where(F.col("taken") > COPIES).withColumn("from", F.explode(F.expr(f"sequence(0L, taken - 1, {COPIES}L)"))).repartition(*names, "id", "from")
    each = few.unionByName(many).withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("taken")) - 1)))
    each = each.select("id", *names, F.col("epochs").alias("epoch"), "n_tokens", F.least(F.col("n_tokens"), F.col("left") - F.col("copy") * F.col("n_tokens")).alias("take_tokens"))
    return whole.unionByName(each).withColumnRenamed("id", id_col)


def keep_mixed(df: DataFrame, levels: dict[str, Column], weights: dict[str, int], fraction: tuple[int, int], seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, of which mix_sources takes at least a token in one epoch.

    What a leaf takes is a prefix of its order, so one row per leaf, the last that it takes,
    decides: the texts are filtered where they are scanned and not shuffled, as long as the
    leaves are few enough to be sent to every task, which Spark decides by their size. Rows that
    repeat an id stay or go together.
    """
    names = [f"_mix_{n}" for n in levels]
    expressions = {f"_mix_{n}": c for n, c in levels.items()}
    order = F.struct(seeded_order(seed, F.lit(0), F.col("_mix_id")).alias("order"), F.col("_mix_id").alias("id"))
    taken = mix_sources(df, expressions, weights, fraction, 1, seed, id_col, word_tokens(F.col(text_col))).withColumnRenamed(id_col, "_mix_id")
    last = materialize(taken.groupBy(*names).agg(F.max(order).alias("_mix_last")), "last")
    rows = df.withColumns({n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in expressions.items()} | {"_mix_id": F.col(id_col).cast("long")})
    kept = rows.where(word_tokens(F.col(text_col)) > 0).join(last, names).where(order <= F.col("_mix_last"))
    return kept.select(*[kept[c] for c in df.columns])
