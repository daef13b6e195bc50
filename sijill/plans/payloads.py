"""Queries of payloads and documents as a whole (survey 2.3, 2.8, 2.12, 2.13)."""

from pyspark.sql import functions as F

from sijill.functions.dialect import query
from sijill.operators import payloads as P
from sijill.session import table, texts

_ALL = {
    "parse_metrics": (P.parse_metrics, "loaded_legal_json"),
    "decision_gaps": (P.decision_gaps, "loaded_legal_json"),
    "telling_lines": (P.telling_lines, "search_records", "loaded_legal_json"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}


def standard_payloads(spark, folder):
    return P.standard_payloads(texts(spark, folder, "loaded_legal_json", "record_id", "source_file", "long_text"))


def element_errors(spark, folder):
    return P.element_errors(texts(spark, folder, "loaded_legal_json", "record_id", "payload", "long_text"))


def repaired_titles(spark, folder):
    return table(spark, folder, "search_records").select("search_id", P.repaired(F.col("title")).alias("title"))


QUERIES = {name: run for name, (run, _) in _BUILT.items()} | {f.__name__: f for f in (standard_payloads, element_errors, repaired_titles)}
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
