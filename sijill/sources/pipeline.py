"""From files to an index: read, structure, chunk, put in place (survey 2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.dialect import SPARK
from sijill.operators import chunking as C
from sijill.operators import decisions as D
from sijill.operators import payloads as P
from sijill.session import materialize
from sijill.sources import documents as S
from sijill.sources import records as R


def loaded(spark: SparkSession, path: str, recursive: bool = True, government: bool = False) -> DataFrame:
    """(record_id, source_file, long_text, error) of every file that a reader takes. Ids follow from the paths."""
    files = S.read_documents(spark, path, recursive, government, extensions=S.SUPPORTED)
    return materialize(files.select(F.xxhash64("path").alias("record_id"), F.col("filename").alias("source_file"), F.col("raw_text").alias("long_text"), "error"), "documents")


def chunked(documents: DataFrame) -> DataFrame:
    """(chunk_id, source_file, document_id, text, section_title, chunk_index, total_chunks) by the legal chunker."""
    documents.createOrReplaceTempView(SPARK.table("loaded_legal_json"))
    spans = documents.sparkSession.sql(D.legal_spans(SPARK)).withColumn("span", F.xxhash64("record_id", "first"))
    # pieces find their span by both numbers again: a hash only stands for the pair on the way through the workers
    pieces = C.pack_sentences(spans, "span", "text").join(spans.drop("text"), "span").join(documents.select("record_id", "source_file"), "record_id")
    ids = F.concat_ws("_", F.sha1(F.coalesce("source_file", F.lit(""))), "label", F.col("first").cast("string"), (F.col("chunk_index") + 1).cast("string"))
    return pieces.select(F.concat_ws("_", "label", F.col("first").cast("string"), F.substring(F.sha1(ids), 1, 12)).alias("chunk_id"), "source_file", F.col("record_id").cast("string").alias("document_id"), "text", F.col("label").alias("section_title"), "chunk_index", "total_chunks")


def process(spark: SparkSession, path: str, target: str, recursive: bool = True, government: bool = False) -> DataFrame:
    """Every file under `path` read, its payload written under target/documents, its chunks put into target/index; (source_file, status) of each.

    Sources processed before are replaced, others stay. Files that can't be read say why
    and change nothing.
    """
    rows = loaded(spark, path, recursive, government)
    good = rows.where("error IS NULL").drop("error")
    payloads = P.standard_payloads(good).join(good.select("record_id", "source_file"), "record_id")
    R.update_records(payloads.select("source_file", "payload"), f"{target}/documents", ["source_file"])
    R.index_chunks(chunked(good), f"{target}/index")
    return rows.select("source_file", F.coalesce("error", F.lit("indexed")).alias("status"))
