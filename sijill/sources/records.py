"""Chunk records and repository documents as JSON, read and written (survey 2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.operators import registry as G
from sijill.session import exists, materialize

CHUNK_SCHEMA = "chunk_id string, text string, source_file string, document_id string, document_title string, document_type string, page_number int, chunk_index int, total_chunks int, section_title string, article_reference string, block_type string, year string, source_type string"


def read_chunk_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunk records from JSON lines. Leniently, broken lines and records without text are left out; strictly, they and repeated or missing ids raise."""
    if not strict:
        return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checked = rows.withColumn("chunk_id", F.when(blank("chunk_id") | blank("text") | blank("source_file"), F.raise_error(F.lit("a chunk lacks its id, text or source")).cast("string")).otherwise(F.col("chunk_id")))
    twice = F.count(F.lit(1)).over(W.partitionBy("chunk_id")) > 1
    return checked.withColumn("_twice", twice).withColumn("chunk_id", F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("repeated chunk id "), F.col("chunk_id"))).cast("string")).otherwise(F.col("chunk_id"))).drop("_twice")


def read_repository(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """JSON documents of a folder tree, one a file; of repeated ids the first path's stays, documents without an id are left out."""
    docs = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path).withColumn("path", F.input_file_name())
    first = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("path").alias("path"))
    return docs.join(first, [key, "path"], "left_semi")


def write_chunks(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, overwritten as a whole or, with `by`, in the partitions that the rows touch."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_records(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of `by`."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def export_registry(citations: DataFrame, path: str) -> None:
    """The registry as one JSON object a line: id and citation."""
    citations.select(F.to_json(F.struct("chunk_id", F.struct(*[c for c in citations.columns if c != "chunk_id"]).alias("citation"))).alias("value")).write.mode("overwrite").text(path)


def save_registry(citations: DataFrame, path: str) -> None:
    """The registry as tables: one citation a chunk id, the counts of laws and articles, and the head that says when and how many."""
    rows = materialize(citations.groupBy("chunk_id").agg(F.min(F.struct(*[c for c in citations.columns if c != "chunk_id"])).alias("c")).select("chunk_id", "c.*"), "registry")
    rows.write.mode("overwrite").parquet(f"{path}/by_chunk_id")
    laws = rows.groupBy("law", "article").agg(F.count(F.lit(1)).alias("n_chunks"))
    laws.write.mode("overwrite").parquet(f"{path}/by_law_article")
    totals = rows.agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("law").alias("n_laws"))
    totals.select(F.lit(1).alias("schema_version"), F.current_timestamp().alias("generated_at"), "chunk_count", "n_laws").write.mode("overwrite").parquet(f"{path}/head")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's citations; none where it was never saved."""
    if not exists(spark, f"{path}/by_chunk_id"):
        return spark.createDataFrame([], "chunk_id string, law string, article string")
    return spark.read.parquet(f"{path}/by_chunk_id")


def registry_head(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/head")


def update_records(changes: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines with the changed rows in place of those with their keys; a new table where there is none."""
    spark = changes.sparkSession
    if exists(spark, path):
        changes = G.upsert(spark.read.schema(changes.schema).json(path), changes, keys)
    # read in full before the table is replaced
    materialize(changes, "update").write.mode("overwrite").json(path)


def index_chunks(chunks: DataFrame, path: str) -> None:
    """Put chunks into a chunk table: equal rows once, repeated ids made unique, and all rows of their sources replaced."""
    spark = chunks.sparkSession
    fresh = G.unique_ids(chunks.distinct(), "chunk_id", "text").drop("chunk_id").withColumnRenamed("unique_id", "chunk_id").select(*chunks.columns)
    if exists(spark, path):
        fresh = G.upsert(spark.read.schema(chunks.schema).parquet(path), fresh, ["source_file"])
    materialize(fresh, "index").write.mode("overwrite").parquet(path)


def import_records(spark: SparkSession, path: str, target: str) -> None:
    """An export's JSON lines into a chunk table, by index_chunks."""
    index_chunks(read_chunk_records(spark, path), target)


def transcript(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Conversations as text, a line a turn in order; a conversation's turns are few by nature."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
