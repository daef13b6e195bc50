"""Queries of law sections (survey 2.9, 2.10)."""

from sijill.functions.dialect import query
from sijill.operators import law as L

_ALL = {
    "law_sections": (L.law_sections, "loaded_legal_json"),
    "law_scores": (L.law_scores, "search_records", "loaded_legal_json"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}
QUERIES = {name: run for name, (run, _) in _BUILT.items()}
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
