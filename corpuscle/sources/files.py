"""Sources: bounded files, packages as JSON, reference tables with overrides, recorded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024


def mime_of(content: Column, name: Column) -> Column:
    """By the first bytes (PDF; ZIP with the name's ending), else text if it is UTF-8, else unknown."""
    archive = F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")
    return (
        F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "application/pdf")
        .when(archive & F.lower(name).endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(archive & F.lower(name).endswith(".pptx"), "application/vnd.openxmlformats-officedocument.presentationml.presentation")
        .when(F.is_valid_utf8(content.cast("string")) & ~archive, F.when(F.lower(name).endswith(".md"), "text/markdown").otherwise("text/plain"))
    )


def read_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, sha256, mime, content) of the files of at most `most` bytes; longer ones are not read, rejected_files() names them."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), mime_of(F.col("content"), F.col("path")).alias("mime"), "content")


def rejected_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, reason) of the files that read_files() refuses by their listed length, without reading them."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path", "length", F.lit(f"over {most} bytes").alias("reason"))


#: Which parser reads what.
PARSERS = {"text/plain": "text", "text/markdown": "text", "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx"}


def parser_of(mime: Column) -> Column:
    """The name of the parser of a kind of content; null without one."""
    out = F.lit(None).cast("string")
    for kind, name in PARSERS.items():
        out = F.when(mime == kind, F.lit(name)).otherwise(out)
    return out


def read_texts(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, path, text) of the text files, by content or by name: UTF-8, else Latin-1, with plain line ends. doc_id is the content's SHA-256."""
    f = read_files(spark, path, most)
    f = f.where(F.coalesce(F.col("mime").startswith("text/"), F.lower("path").rlike("\\.(txt|md)$")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return f.select(F.col("sha256").alias("doc_id"), "path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))


def archive_verdicts(members: DataFrame, archive: str = "path", most_members: int = 2000, most_bytes: int = 200 * 1024 * 1024, most_ratio: float = 200.0, ratio_from: int = 1024 * 1024) -> DataFrame:
    """(archive, n_members, bytes, reason) from a listing (archive, name, size, compressed): too many members, too large in all, or a large member packed too tightly; reason is null for a sound one."""
    tight = (F.col("size") >= ratio_from) & (F.col("size") > most_ratio * F.greatest("compressed", F.lit(1)))
    g = members.groupBy(archive).agg(F.count("*").alias("n_members"), F.sum("size").alias("bytes"), F.bool_or(tight).alias("tight"))
    reason = F.when(F.col("n_members") > most_members, "members").when(F.col("bytes") > most_bytes, "size").when(F.col("tight"), "ratio")
    return g.select(archive, "n_members", "bytes", reason.alias("reason"))


def read_packages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Packages, one JSON document a file, by a declared schema: unknown fields are dropped, broken files keep their text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Idempotent insert: the first row of each key; rows without one all stay."""
    rest = [c for c in rows.columns if c != key]
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns])
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def with_overrides(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A dimension whose rows are the defaults' (one row) with what each override row sets."""
    values = [c for c in defaults.columns if c != key]
    one = defaults.select(*[F.col(c).alias(f"_{c}") for c in values]).limit(1)
    return overrides.join(F.broadcast(one)).select(key, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in values])


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Answers to requests (request_id, stage, system, user, schema) from recorded ones (key or stage, response): by the request's hash, else by its stage, else null with `missed`."""
    key = F.substring(F.sha2(F.concat_ws("\n", "stage", "system", "user", "schema"), 256), 1, 16)
    r = requests.withColumn("key", key)
    exact = recorded.where("key is not null").select("key", F.col("response").alias("_exact"))
    by_stage = recorded.where("key is null").groupBy("stage").agg(F.min("response").alias("_stage"))
    out = r.join(exact, "key", "left").join(by_stage, "stage", "left")
    return out.select("request_id", "stage", F.coalesce("_exact", "_stage").alias("response"), F.coalesce("_exact", "_stage").isNull().alias("missed"))
