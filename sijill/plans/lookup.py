"""Queries of lookups across tables (survey 2.2, 2.3, 2.5, 2.6)."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.functions import extract as X
from sijill.operators import registry as R
from sijill.session import table


def full_text_index(spark, folder):
    """Each name by which a record may be asked for (id, file, file without ending) with the text of the first record so named, ids before files before stems."""
    rows = table(spark, folder, "loaded_legal_json").where("long_text IS NOT NULL")
    named = F.array(
        F.struct(F.lit(1).alias("kind"), F.col("document_id").alias("name")),
        F.struct(F.lit(2).alias("kind"), F.col("source_file").alias("name")),
        F.struct(F.lit(3).alias("kind"), F.regexp_replace("source_file", r"\.[^.]*$", "").alias("name")),
    )
    keys = rows.select("record_id", F.inline(named)).where("name IS NOT NULL")
    first = keys.groupBy("name").agg(F.min(F.struct("kind", "record_id")).alias("b")).select("name", "b.kind", "b.record_id")
    return first.join(rows.select("record_id", F.md5(F.col("long_text").cast("binary")).alias("digest")), "record_id")


def question_document_match(spark, folder):
    """The document whose title shares most words with a question, if it is one alone; a question's own record doesn't count."""
    rows = table(spark, folder, "search_records").where("document_id IS NOT NULL").select("search_id", "document_id", A.match_tokens(F.col("title")).alias("ws"))
    asked = rows.where("search_id % 50 = 0").select(F.col("search_id").alias("query_id"), "ws")
    shared = R.most_shared(asked, rows.select("search_id", "document_id", "ws"))
    best = shared.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    top = best.withColumn("place", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where("place = 1")
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id"), F.max("score").alias("score")).where("n = 1").drop("n")


def output_filenames(spark, folder):
    """A file name for each record, of type, year and number; repeats get a suffix in order of id."""
    n = X.number_and_year(F.col("title"))
    part = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    stem = F.concat_ws("_", F.regexp_replace(part(F.col("document_type"), "document"), r"\s+", "_"), part(n["year"], "unknown"), part(n["number"], "unknown"))
    rows = R.numbered(table(spark, folder, "search_records").select("search_id", stem.alias("stem")), "stem", "search_id")
    return rows.select("search_id", F.concat("stem", F.when(F.col("place") > 1, F.concat(F.lit("_"), F.col("place").cast("string"))).otherwise(F.lit("")), F.lit(".json")).alias("filename"))


def citations_for_results(spark, folder):
    """The registry's entry for each deleted chunk, the latest where several name it."""
    gone = table(spark, folder, "chunks").where("is_deleted").select("chunk_id").distinct()
    entries = table(spark, folder, "citation_registry").where("chunk_id IS NOT NULL").select("chunk_id", "entry_id", "legal_reference", "page_number")
    return R.last_per_key(entries, ["chunk_id"], [F.col("entry_id")]).join(gone, "chunk_id")


def chunk_counts_by_month(spark, folder):
    """Chunks, characters and different sources of each month and type."""
    rows = table(spark, folder, "chunks")
    return rows.groupBy(F.date_format("indexed_at", "yyyy-MM").alias("month"), "document_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("source_file").alias("n_sources"))


QUERIES = {f.__name__: f for f in (full_text_index, question_document_match, output_filenames, citations_for_results, chunk_counts_by_month)}

_N = lambda p: f"nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{p}', 1)''')}, '')"
SQL = {
    "full_text_index": "WITH r AS (SELECT * FROM loaded_legal_json WHERE long_text IS NOT NULL), k AS (SELECT record_id, 1 AS kind, document_id AS name FROM r UNION ALL SELECT record_id, 2, source_file FROM r UNION ALL SELECT record_id, 3, regexp_replace(source_file, '\\.[^.]*$', '') FROM r), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, record_id) AS n FROM k WHERE name IS NOT NULL) SELECT name, kind, f.record_id, md5(long_text) AS digest FROM f JOIN r USING (record_id) WHERE n = 1",
    "question_document_match": f"WITH w AS (SELECT search_id, document_id, unnest({A.match_tokens_sql('title')}) AS word FROM search_records WHERE document_id IS NOT NULL), s AS (SELECT a.search_id AS query_id, b.document_id, b.search_id, count(*) AS score FROM w a JOIN w b USING (word) WHERE a.search_id % 50 = 0 AND a.search_id <> b.search_id GROUP BY 1, 2, 3), "
    "d AS (SELECT query_id, document_id, max(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM d) SELECT query_id, min(document_id) AS document_id, max(score) AS score FROM r WHERE place = 1 GROUP BY query_id HAVING count(*) = 1",
    "output_filenames": f"WITH s AS (SELECT search_id, concat_ws('_', regexp_replace(coalesce(nullif(trim(document_type), ''), 'document'), '\\s+', '_', 'g'), coalesce({_N(X.YEAR)}, 'unknown'), coalesce({_N(X.NUMBER)}, 'unknown')) AS stem FROM search_records), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY search_id) AS place FROM s) "
    "SELECT search_id, stem || CASE WHEN place > 1 THEN '_' || place ELSE '' END || '.json' AS filename FROM n",
    "citations_for_results": "SELECT chunk_id, entry_id, legal_reference, page_number FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY entry_id DESC) AS n FROM citation_registry WHERE chunk_id IS NOT NULL) WHERE n = 1 AND chunk_id IN (SELECT chunk_id FROM chunks WHERE is_deleted)",
    "chunk_counts_by_month": "SELECT strftime(indexed_at AT TIME ZONE 'UTC', '%Y-%m') AS month, document_type, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, count(DISTINCT source_file) AS n_sources FROM chunks GROUP BY 1, 2",
}
