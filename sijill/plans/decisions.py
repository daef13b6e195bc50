"""Queries of decision metadata, values and content (survey 2.7, 2.11)."""

from pyspark.sql import functions as F

from sijill.functions.dialect import query
from sijill.operators import chunking as C
from sijill.operators import decisions as D

_ALL = {
    "decision_metadata_fields": (D.metadata, "loaded_legal_json"),
    "decision_metadata_word": (D.second_metadata, "loaded_legal_json"),
    "decision_values": (D.field_values, "loaded_legal_json"),
    "legal_spans": (D.legal_spans, "loaded_legal_json"),
    "decision_content": (D.content, "loaded_legal_json"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}


def legal_chunks(spark, folder):
    """Every record's chunks by the legal chunker: its spans, packed by sentences where they are too large, with stable ids."""
    spans = D.with_number(_BUILT["legal_spans"][0](spark, folder))
    packed = C.pack_sentences(spans, "span", "text")
    named = packed.join(spans.drop("text"), "span")
    ids = F.concat_ws("_", F.concat(F.lit("record"), F.col("record_id").cast("string")), "label", F.col("first").cast("string"), (F.col("chunk_index") + 1).cast("string"))
    return named.select("record_id", F.concat_ws("_", ids, F.substring(F.sha1(ids), 1, 12)).alias("chunk_id"), "label", "first", "last", "chunk_index", "total_chunks", "text")


QUERIES = {name: run for name, (run, _) in _BUILT.items()}
QUERIES["legal_chunks"] = legal_chunks
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
