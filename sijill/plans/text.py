"""Queries of the text functions (survey 2.10)."""

from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.operators.retrieval import term_frequencies
from sijill.session import spread, table


def normalize_digits(spark, folder):
    return table(spark, folder, "search_records").select("search_id", A.fold_digits(F.col("decision_number")).alias("number"))


def normalize_search(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", A.normalize_search(F.col("text")).alias("norm"))


def presentation_forms(spark, folder):
    return spread(table(spark, folder, "chunks")).select("row_id", A.plain_forms(F.col("text")).alias("clean"))


def token_counts(spark, folder):
    """Terms of all documents: how often, and in how many."""
    per_doc = term_frequencies(spread(table(spark, folder, "documents")), "doc_id", "text")
    return per_doc.groupBy("term").agg(F.sum("tf").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))


def token_variants(spark, folder):
    return table(spark, folder, "search_records").select("search_id", F.array_join(A.search_tokens(F.col("title")), " ").alias("tokens"))


def search_blob(spark, folder):
    return table(spark, folder, "search_records").select("search_id", F.size(F.array_distinct(A.search_tokens(F.col("title")))).cast("long").alias("n_terms"), F.length(A.search_blob(F.col("title"))).cast("long").alias("n_chars"))


def document_match_tokens(spark, folder):
    return table(spark, folder, "search_records").select("search_id", A.match_text(F.col("filename")).alias("name"), F.array_join(F.array_sort(A.match_tokens(F.col("filename"))), " ").alias("tokens"))


def squeeze_whitespace(spark, folder):
    return spread(table(spark, folder, "chunks")).select("row_id", A.squeeze(F.col("text")).alias("text"))


QUERIES = {
    "normalize_digits": normalize_digits,
    "normalize_search": normalize_search,
    "presentation_forms": presentation_forms,
    "tokenize_counts": token_counts,
    "token_variants": token_variants,
    "search_blob": search_blob,
    "document_match_tokens": document_match_tokens,
    "squeeze_whitespace": squeeze_whitespace,
}
_T = A.search_tokens_sql("title")
SQL = {
    "normalize_digits": f"SELECT search_id, {A.fold_digits_sql('decision_number')} AS number FROM search_records",
    "normalize_search": f"SELECT doc_id, {A.normalize_search_sql('text')} AS norm FROM documents",
    "presentation_forms": f"SELECT row_id, {A.plain_forms_sql('text')} AS clean FROM chunks",
    "tokenize_counts": f"WITH t AS (SELECT doc_id, unnest({A.search_tokens_sql('text')}) AS term FROM documents) SELECT term, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY term",
    "token_variants": f"SELECT search_id, array_to_string({_T}, ' ') AS tokens FROM search_records",
    "search_blob": f"WITH b AS (SELECT search_id, {A.normalize_search_sql('title')} AS n, {_T} AS t FROM search_records), c AS (SELECT search_id, n, t, length(array_to_string(list_distinct(t), ' ')) AS k FROM b) "
    "SELECT search_id, len(list_distinct(t)) AS n_terms, length(n) + k + CASE WHEN n <> '' AND k > 0 THEN 1 ELSE 0 END AS n_chars FROM c",
    "document_match_tokens": f"SELECT search_id, {A.match_text_sql('filename')} AS name, array_to_string(list_sort({A.match_tokens_sql('filename')}), ' ') AS tokens FROM search_records",
    "squeeze_whitespace": f"SELECT row_id, {A.squeeze_sql('text')} AS text FROM chunks",
}
