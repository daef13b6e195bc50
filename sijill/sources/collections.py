"""A chunk collection kept as a parquet table: made, filled, read, cut down, dropped (survey 2.2, 2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.operators import registry as G
from sijill.session import clear_scratch, exists, materialize
from sijill.sources.records import CHUNK_SCHEMA


class Collection:
    """Chunks by id. Every change is written beside the table first, so readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA):
        self.spark, self.path, self.schema = spark, path, schema

    def create(self) -> Collection:
        """The collection as it is, or a new empty one."""
        if not exists(self.spark, self.path):
            self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _replace(self, rows: DataFrame) -> None:
        materialize(rows, "collection").write.mode("overwrite").parquet(self.path)

    def upsert(self, rows: DataFrame) -> None:
        """Rows by id; of several with one id in `rows`, the greatest text stays."""
        fresh = rows.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("text", *[c for c in rows.columns if c not in ("chunk_id", "text")])).alias("r")).select("chunk_id", "r.*")
        missing = [F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in self.schema.split(", ")) if n not in fresh.columns]
        self._replace(G.upsert(self.read(), fresh.select("*", *missing).select(*self.read().columns), ["chunk_id"]))

    def delete(self, ids: DataFrame) -> None:
        """Without the chunks whose id is among `ids` (column chunk_id)."""
        self._replace(G.delete_where(self.read(), ids, ["chunk_id"]))

    def delete_source(self, source_file: str) -> int:
        """Without a source's chunks; how many went."""
        gone = self.read().where(F.col("source_file").eqNullSafe(source_file))
        n = gone.count()
        if n:
            self._replace(self.read().where(~F.col("source_file").eqNullSafe(source_file)))
        return n

    def clear(self) -> None:
        self._replace(self.read().limit(0))

    def drop(self) -> None:
        clear_scratch(self.spark, self.path)

    def get(self, chunk_id: str) -> DataFrame:
        return self.read().where(F.col("chunk_id") == chunk_id)

    def find(self, title: str | None = None, document_type: str | None = None, source_file: str | None = None) -> DataFrame:
        """Chunks whose title holds a text, whose type is one, whose file is one; case doesn't count for the first two."""
        rows = self.read()
        if title is not None:
            rows = rows.where(F.contains(F.lower("document_title"), F.lower(F.lit(title))))
        if document_type is not None:
            rows = rows.where(F.lower("document_type") == document_type.lower())
        return rows if source_file is None else rows.where(F.col("source_file") == source_file)

    def documents(self) -> DataFrame:
        """(source_file, n_chunks, n_pages, n_characters, title) of every file."""
        return self.read().groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("page_number").alias("n_pages"), F.sum(F.length("text")).alias("n_characters"), F.min("document_title").alias("title"))

    def stats(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("source_file").alias("n_sources"), F.countDistinct("document_id").alias("n_documents"))

    def export(self, path: str) -> None:
        """JSON lines of all chunks."""
        self.read().write.mode("overwrite").json(path)

    def import_(self, path: str) -> None:
        self.upsert(self.spark.read.schema(self.schema).json(path))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of a text file's non-blank lines; lines that begin with # are notes. Ids follow the files and lines."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("text"))
    return lines.where("text <> '' AND NOT startswith(text, '#')").select(F.col("at").alias("query_id"), "text")


def write_answers(answers: DataFrame, path: str) -> None:
    """One JSON object a question."""
    answers.write.mode("overwrite").json(path)
