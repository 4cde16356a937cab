"""Text traces, manifests, recipe files, reports, and traces made from tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.ids import content_id
from fathomline.functions.storage import stored
from fathomline.operators.ordinals import block_ordinal


def read_manifest(spark: SparkSession, path: str, trace: str = "trace") -> DataFrame:
    """``trace, version, name``: one version per line, in order; the first space-delimited token is the file's name."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "")).alias("version", "line"))
    return lines.select(F.lit(trace).alias("trace"), F.col("version").cast("int").alias("version"), F.split("line", " ")[0].alias("name"))


def read_trace(spark: SparkSession, folder: str, versions: DataFrame) -> DataFrame:
    """``trace, version, pos, chunk_id`` of the files (or folders of part files) that ``versions`` names, and of no others; blank lines are skipped.

    Line numbers come from the rank inside a file block and the counts of the blocks before it.
    """
    names = sorted({r.name for r in versions.select("name").collect()})  # one row per version
    if not names:
        return spark.createDataFrame([], "trace string, version int, pos long, chunk_id string")
    path = F.split(F.col("_metadata.file_path"), "/")
    last, above = F.element_at(path, -1), F.element_at(path, -2)
    lines = spark.read.text([f"{folder.rstrip('/')}/{n}" for n in names]).select(
        F.when(last.isin(names), last).otherwise(above).alias("name"), F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+")[0].alias("chunk_id"))
    rows = stored(lines.where(F.col("chunk_id") != "").join(F.broadcast(versions), "name"), "lines")  # versions: one row per file
    return block_ordinal(rows, ["trace", "version"], ["part", "block"], ["line"], "pos").select("trace", "version", "pos", "chunk_id")


def write_trace(chunks: DataFrame, folder: str) -> None:
    """One text file per version of one trace, in order: ``v<version>.txt`` folders of Spark part files.

    Rows are sorted by the file's name and position: the writer needs the name's order, and would sort by the name alone, which
    does not keep the order of positions once a sort spills.
    """
    named = chunks.repartitionByRange("version", "pos").withColumn("file", F.concat(F.lit("v"), F.col("version").cast("string")))
    named.sortWithinPartitions("file", "pos").select(F.col("chunk_id").alias("value"), "file").write.partitionBy("file").text(folder)


def read_written_trace(spark: SparkSession, folder: str, trace: str) -> DataFrame:
    """What ``write_trace`` wrote; part files are ordered by name."""
    lines = spark.read.text(folder).select(
        F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("version"), F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+")[0].alias("chunk_id"))
    rows = stored(lines.where(F.col("chunk_id") != "").withColumn("trace", F.lit(trace)), "lines")
    return block_ordinal(rows, ["trace", "version"], ["part", "block"], ["line"], "pos").select("trace", "version", "pos", "chunk_id")


def write_recipes(recipes: DataFrame, folder: str) -> None:
    """Recipes as Parquet, a folder per version."""
    recipes.select("trace", "recipe_id", "slot", "chunk_id", "location", "version").write.partitionBy("version").parquet(folder)


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """``trace, recipe_id, slot, chunk_id, location`` of what ``write_recipes`` wrote."""
    return spark.read.schema("trace string, recipe_id long, slot int, chunk_id string, location long, version int").parquet(folder).drop("version")


def export_recipe_files(recipes: DataFrame, folder: str) -> None:
    """Text recipes of one trace on request: a line ``recipe_id<tab>id location id location ...`` per recipe, in files of many recipes.

    A file for each recipe, as the original writes, would make files in proportion to the chunks; ``read_recipe_files`` reads both.
    """
    pair = F.struct("slot", F.concat_ws(" ", "chunk_id", F.col("location").cast("string")).alias("p"))
    body = recipes.groupBy("recipe_id").agg(F.array_sort(F.collect_list(pair)).alias("b"))  # at most container_size pairs
    body.select(F.concat_ws("\t", F.col("recipe_id").cast("string"), F.array_join(F.transform("b", lambda x: x["p"]), " ")).alias("value")).write.text(folder)


def read_recipe_files(spark: SparkSession, folder: str, trace: str) -> DataFrame:
    """``trace, recipe_id, slot, chunk_id, location`` of text recipes: lines that begin with the recipe's id and a tab, or files of one line whose name is the recipe's id, or folders ``recipe_id=<id>``."""
    path, line = F.col("_metadata.file_path"), F.split("value", "\t", 2)
    number = F.coalesce(F.nullif(F.regexp_extract(path, r"recipe_id=(\d+)/", 1), F.lit("")), F.regexp_extract(path, r"(\d+)$", 1))
    text = spark.read.option("recursiveFileLookup", "true").text(folder)
    named = number == ""  # no id in the path
    tokens = text.select(F.when(named, line[0]).otherwise(number).cast("long").alias("recipe_id"), F.split(F.trim(F.when(named, line[1]).otherwise(F.col("value"))), r"\s+").alias("t")).where(F.size("t") > 1)
    slots = tokens.select("recipe_id", "t", F.explode(F.sequence(F.lit(0), (F.size("t") / 2).cast("int") - 1)).alias("slot"))
    return slots.select(F.lit(trace).alias("trace"), "recipe_id", "slot", F.col("t")[F.col("slot") * 2].alias("chunk_id"), F.col("t")[F.col("slot") * 2 + 1].cast("long").alias("location"))


def write_version_report(report: DataFrame, path: str) -> None:
    """One space-separated line per version, in order."""
    report.orderBy("trace", "version").coalesce(1).write.option("sep", " ").csv(path)  # one row per version


def read_version_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", " ").csv(path)


def write_window_rates(windows: DataFrame, path: str) -> None:
    """Per version of one trace, lines of window number and rate."""
    windows.select("version", "seq", "rate").write.partitionBy("version").option("sep", " ").csv(path)


def read_window_rates(spark: SparkSession, path: str) -> DataFrame:
    """``version, seq, rate``."""
    return spark.read.schema("seq long, rate double, version int").option("sep", " ").csv(path).select("version", "seq", "rate")


def chunks_from_table(rows: DataFrame, trace: str, version: Column, content: Column, block: Column, order: list[Column], make_id: Callable[[Column], Column] = content_id) -> DataFrame:
    """``trace, version, pos, chunk_id`` from a table; rows with a null version are left out. ``block`` must rise with ``order``; ``make_id`` as in ``snapshot_trace``."""
    cols = [o.alias(f"o{i}") for i, o in enumerate(order)]
    picked = rows.select(F.lit(trace).alias("trace"), version.cast("int").alias("version"), make_id(content).alias("chunk_id"), block.cast("long").alias("block"), *cols)
    numbered = block_ordinal(picked.where("version is not null"), ["trace", "version"], ["block"], [f"o{i}" for i in range(len(order))], "pos")
    return numbered.select("trace", "version", "pos", "chunk_id")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_trace(spark: SparkSession, sf_dir: str, versions: int = 5, make_id: Callable[[Column], Column] = content_id, spread: bool = False) -> DataFrame:
    """Backups of ``orders`` of which a fifth of the rows changes per version.

    ``make_id``: ``content_number`` gives ids as numbers. ``spread`` deals the keys over all tasks first, as a file may have few row groups.
    """
    keys = _table(spark, sf_dir, "orders").select("o_orderkey")
    keys = keys.repartitionByRange("o_orderkey") if spread else keys
    rows = keys.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(versions - 1))).alias("version"))
    content = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.floor((F.col("version") + F.col("o_orderkey") % 5) / 5).cast("string"))
    return rows.select(F.lit("snapshot").alias("trace"), "version", F.col("o_orderkey").alias("pos"), make_id(content).alias("chunk_id"))


def lineitem_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return chunks_from_table(rows, "lineitem", F.year("l_shipdate") - 1995, F.col("l_partkey"), F.floor(F.col("l_orderkey") / 4096), order)


def doc_lines_trace(spark: SparkSession, sf_dir: str, make_id: Callable[[Column], Column] = content_id) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return chunks_from_table(lines, "doc_lines", F.col("doc_id") % 5, F.col("line"), F.floor(F.col("doc_id") / 256), [F.col("doc_id"), F.col("line_no")], make_id)


def events_trace(spark: SparkSession, sf_dir: str, make_id: Callable[[Column], Column] = content_id) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    content = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    return chunks_from_table(rows, "events", F.floor(days / 6), content, F.unix_timestamp("ts") / 3600, [F.col("ts"), F.col("event_id")], make_id)


def all_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshot_trace(spark, sf_dir)
    for make in (lineitem_trace, doc_lines_trace, events_trace):
        out = out.unionByName(make(spark, sf_dir))
    return out
