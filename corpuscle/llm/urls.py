"""URL filters: host and path rules, then a ratio of two character language models.

The models are smoothed variable-order Markov models of accepted and of rejected URLs, which are
those that a rule allows or blocks. They count every context of up to ORDER characters, kept whole as
a table that grows with the corpus and never reaches the driver; Witten-Bell interpolation falls back
to shorter contexts where a class has not met a longer one. A URL's score is the difference of its
log likelihoods by character. One in five of the ruled URLs, by hash, is held out from the counts, and
the threshold is calibrated on those.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cuts, materialize

ORDER = 5
#: Characters of the URLs that are scored together (one longer URL is a chunk of its own).
CHUNK_CHARS = 100_000
START, STOP = "\x02", "\x03"

def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, ASCII capitals lowered; empty without ://, and for null."""
    host = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://, and for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule ("host/path") that fits: the url's host is the rule's or a subdomain, its path starts with the rule's. Null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last to fit is the longest
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def held_back(url: Column) -> Column:
    """Ruled URLs that are not counted, but calibrate the threshold: crc32 of the URL mod 5 is 0."""
    return F.crc32(url.cast("binary")) % 5 == 0


def _grams(url: str) -> list[str]:
    """Every character of the URL and its end, each after its context: the ORDER characters before it, or as many as there are."""
    s = START + url + STOP
    return [s[max(0, i - ORDER) : i + 1] for i in range(1, len(s))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's different grams with the times that accepted and rejected URLs hold them; 0 and 0 for those of other URLs alone."""
    for batch in batches:
        good, bad = Counter(), Counter()
        for url, n_good, n_bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for gram in _grams(url or ""):
                good[gram] += n_good
                bad[gram] += n_bad
        if good:
            yield pa.RecordBatch.from_pydict({"context": [g[:-1] for g in good], "next": [g[-1] for g in good], "good": pa.array(good.values(), pa.int64()), "bad": pa.array([bad[g] for g in good], pa.int64())})


def pair_counts(rows: DataFrame) -> DataFrame:
    """(context, next, good, bad) of every context of up to ORDER characters, from (url, good, bad); nothing is pruned.

    Tasks count, where the URLs are scanned, the longest contexts only; the shorter ones' counts are sums over their extensions.
    """
    longest = rows.select("url", "good", "bad").mapInArrow(_count, "context string, next string, good long, bad long").groupBy("context", "next").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ends = F.transform(F.sequence(F.lit(1), F.length("context") + 1), lambda k: F.substr("context", k))
    return longest.select(F.explode(ends).alias("context"), "next", "good", "bad").groupBy("context", "next").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def probabilities(rows: DataFrame) -> DataFrame:
    """(gram, good, bad): both classes' P(next | context) of every gram that URLs of rows (url, good, bad) hold.

    Order by order each pair takes the probability after its context without the first character, by an
    equi-join. Windows and join keys hold as many rows as there are different characters at most.
    """
    w = Window.partitionBy("context")
    counts = pair_counts(rows).select("context", "next", *[x.alias(f"{c}_{n}") for c in ("good", "bad") for n, x in (("n", F.col(c)), ("total", F.sum(c).over(w)), ("kinds", F.count_if(F.col(c) > 0).over(w)))])
    counts = materialize(counts, "pairs")
    out = shorter = None
    for k in range(ORDER + 1):
        level = counts.where(F.length("context") == k)
        if shorter is None:
            level = level.withColumns({"good": F.lit(1 / 256), "bad": F.lit(1 / 256)})
        else:
            level = level.withColumn("rest", F.substr("context", F.lit(2))).join(shorter.withColumnRenamed("context", "rest"), ["rest", "next"])
        smooth = {c: F.when(F.col(f"{c}_total") > 0, (F.col(f"{c}_n") + F.col(f"{c}_kinds") * F.col(c)) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(c)) for c in ("good", "bad")}
        shorter = materialize(level.select("context", "next", *[p.alias(c) for c, p in smooth.items()]), f"order{k}")
        whole = shorter if k == ORDER else shorter.where(F.col("context").startswith(START))  # a shorter context ends a gram only at a URL's start
        out = whole if out is None else out.unionByName(whole)
    return out.select(F.concat("context", "next").alias("gram"), "good", "bad")


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows with the number of a chunk of CHUNK_CHARS characters of URLs; to be materialized, as it depends on how batches fall."""
    at = rows.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            for start, stop in cuts([n + 1 for n in sizes], CHUNK_CHARS):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([chunk] * part.num_rows, pa.int64())], names=[*part.schema.names, "chunk"])
                chunk += 1

    return rows.mapInArrow(run, rows.withColumn("chunk", F.lit(0).cast("long")).schema)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of each chunk in a batch."""
    for batch in batches:
        by_chunk: dict[int, set] = {}
        for chunk, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_chunk.setdefault(chunk, set()).update(_grams(url or ""))
        for chunk, grams in by_chunk.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(grams), pa.int64()), "gram": pa.array(list(grams), pa.string())})


def scored(rows: DataFrame) -> DataFrame:
    """Adds `ratio` to materialized (url, good, bad, chunk, ...): the log likelihood under the rejected model less that under the accepted one, by character; 0 if a class is missing.

    A chunk asks once for each gram that it holds, however often, so that a gram of all URLs is joined with
    as many rows as there are chunks; then each chunk's URLs meet the chunk's probabilities.
    """
    if rows.where("good + bad > 0").select("good").distinct().count() < 2:
        return rows.drop("chunk").withColumn("ratio", F.lit(0.0))
    known = rows.select("chunk", "url").mapInArrow(_wanted, "chunk long, gram string").join(probabilities(rows), "gram")

    def ratio(urls: pa.Table, model: pa.Table) -> pa.Table:
        good, bad = ({g: math.log(p) for g, p in zip(model["gram"].to_pylist(), model[c].to_pylist(), strict=True)} for c in ("good", "bad"))
        out = []
        for url in urls["url"].to_pylist():
            grams = _grams(url or "")
            out.append((sum(map(bad.__getitem__, grams)) - sum(map(good.__getitem__, grams))) / len(grams))
        return urls.drop_columns(["chunk"]).append_column("ratio", pa.array(out, pa.float64()))

    schema = rows.drop("chunk").withColumn("ratio", F.lit(0.0)).schema
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(ratio, schema)


def calibrate(rows: DataFrame, steps: int = 200) -> float:
    """The ratio above which a URL is rejected: the 1/steps mark with the best balanced accuracy on (ratio, rejected), the highest of equals; 0 if a class is missing.

    Ratios are cut to -10 .. 10, so the driver gets 2 * 20 * steps counts at most.
    """
    bins = rows.groupBy(F.floor(F.greatest(F.least("ratio", F.lit(10.0)), F.lit(-10.0)) * steps).cast("int").alias("bin"), "rejected").agg(F.count("*").alias("n")).collect()
    total = {c: sum(r.n for r in bins if r.rejected == c) for c in (False, True)}
    if not (total[False] and total[True]):
        return 0.0
    best, mark = -1.0, 0.0
    good, bad = 0, total[True]  # accepted below, rejected from the mark on
    for b in sorted({r.bin for r in bins}):
        value = good / total[False] + bad / total[True]
        if value >= best:
            best, mark = value, b / steps
        good += sum(r.n for r in bins if r.bin == b and not r.rejected)
        bad -= sum(r.n for r in bins if r.bin == b and r.rejected)
    return mark


def url_filter(df: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, ratio) of every URL.

    rules: verdict ("allow" or "block") by "host/path". verdict: the longest fitting rule's, else
    "block" if the models' ratio reaches the calibrated threshold, else "allow". A null URL, or
    one without ://, has an empty host and path, which no rule fits; its text (null: empty) is
    judged by the models. Unless rules both allow and block some URLs that are not held back, the
    ratios are 0 and the models allow everything. One row per input row, repeated rows and null ids
    included; other columns are ignored; an empty table gives an empty result.
    """
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for name, verdict in rules.items():
        said = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(said)
    urls = urls.withColumn("said", said)
    counted = lambda verdict: F.coalesce((F.col("said") == verdict) & ~held_back(F.col("url")), F.lit(False)).cast("long")
    rows = urls.withColumns({"good": counted("allow"), "bad": counted("block")})
    rows = materialize(scored(materialize(_chunked(rows), "urls")), "ratios")
    able = not rows.where("ratio <> 0").isEmpty()
    threshold = calibrate(rows.where(F.col("said").isNotNull() & held_back(F.col("url"))).select("ratio", (F.col("said") == "block").alias("rejected"))) if able else float("inf")
    method = F.when(F.col("ratio") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "ratio")
