"""Sinks: last-wins tables, per-stage checkpoints, Markdown, JSON, metric and event texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import last_wins


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], version: int) -> str:
    """Writes the table's next version: the old rows with the new ones over them; readers keep the old version meanwhile."""
    new = rows.withColumn("_age", F.lit(1))
    if version > 0:
        new = new.unionByName(spark.read.parquet(f"{path}/v{version - 1}").withColumn("_age", F.lit(0)))
    target = f"{path}/v{version}"
    last_wins(new, key, ["_age"]).drop("_age").write.parquet(target)
    return target


def put_stage(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the stages that df holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def get_stages(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """What put_stage() holds of one run, all stages."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def without_stages(held: DataFrame, run_id: str, stages: list[str], first: str) -> DataFrame:
    """What stays when a run is taken up again from a stage: its results of that stage and of all later ones go."""
    cleared = stages[stages.index(first) :]
    return held.where((F.col("run_id") != run_id) | ~F.col("stage").isin(*cleared))


def put_artifacts(df: DataFrame, path: str) -> None:
    """Artifacts (package_id, kind, content) by kind; a kind's earlier ones are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def report_lines(stages: DataFrame, title: str = "Evaluation") -> DataFrame:
    """(package_id, markdown): a table of the stages' scores (package_id, stage, score, confidence) of each package; n/a where not measurable."""
    shown = lambda c: F.coalesce(F.format_number(F.col(c), 1), F.lit("n/a"))
    row = F.concat(F.lit("| "), "stage", F.lit(" | "), shown("score"), F.lit(" | "), shown("confidence"), F.lit(" |"))
    g = stages.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("stage", row.alias("row")))).alias("rows"))
    return g.select("package_id", F.concat(F.lit(f"# {title}\n\n| stage | score | confidence |\n|-|-|-|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("markdown"))


def deletable(packages: DataFrame, package_id: str) -> DataFrame:
    """Packages without the deleted one; samples stay."""
    return packages.where((F.col("package_id") != package_id) | F.col("is_sample"))


def markdown(sections: DataFrame, doc: str, order: str, title: str, body: str) -> DataFrame:
    """(doc, markdown): the sections of each document in order."""
    part = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body))
    g = sections.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("rows"))
    return g.select(doc, F.array_join(F.transform("rows", lambda r: r["p"]), "\n\n").alias("markdown"))


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON text."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def metric_lines(samples: DataFrame) -> DataFrame:
    """Exposition text lines of (name, labels map, value), sorted by name and labels."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    shown = F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise("")
    return samples.select("name", F.concat("name", shown, F.lit(" "), F.col("value").cast("string")).alias("line")).orderBy("name", "line")


def event_frame(seq: Column, kind: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))
