"""Queries of the chunkers and of document records (survey 2.3, 2.7, 2.10)."""

from pyspark.sql import functions as F

from sijill.operators import chunking as C
from sijill.session import table, texts


def chunk_overlap(spark, folder):
    return C.split_overlap(texts(spark, folder, "loaded_legal_json", "record_id", "long_text"), "record_id", "long_text")


def chunk_sentence_pack(spark, folder):
    return C.pack_sentences(texts(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def stable_document_id(spark, folder):
    ids = C.stable_id(F.coalesce("filename", F.lit("")), F.coalesce("year", F.lit("")), F.coalesce("title", F.lit("")))
    return table(spark, folder, "search_records").select("search_id", ids.alias("stable_id"))


QUERIES = {f.__name__: f for f in (chunk_overlap, chunk_sentence_pack, stable_document_id)}
SQL = {
    "stable_document_id": "SELECT search_id, 'legal_json_' || substring(sha1(coalesce(filename, '') || '|' || coalesce(year, '') || '|' || coalesce(title, '')), 1, 12) AS stable_id FROM search_records",
}
