"""Queries of what questions ask for (survey 2.4, 2.10)."""

from sijill.functions.dialect import query
from sijill.operators import questions as Q

_ALL = {
    "question_predicates": (Q.predicates, "search_records"),
    "question_expansion": (Q.expanded, "search_records"),
    "question_markers": (Q.markers, "search_records", "loaded_legal_json"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}
QUERIES = {name: run for name, (run, _) in _BUILT.items()}
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
