"""Queries of answers and their sources (survey 2.8 to 2.10, 2.13)."""

from sijill.functions.dialect import query
from sijill.operators import answers as A

_ALL = {
    "answer_texts": (A.answer_texts, "chunks", "loaded_legal_json"),
    "answer_checks": (A.answer_checks, "chunks", "loaded_legal_json"),
    "answer_contexts": (A.answer_contexts, "chunks", "loaded_legal_json"),
    "answer_layouts": (A.answer_layouts, "chunks"),
    "direct_facts": (A.direct_facts, "search_records", "loaded_legal_json"),
    "full_text_match": (A.full_text_match, "search_records", "loaded_legal_json"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}
QUERIES = {name: run for name, (run, _) in _BUILT.items()}
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
