"""Queries of further readers (survey 2.6, 2.10 to 2.12)."""

from sijill.functions.dialect import query
from sijill.operators import readers as R

_ALL = {
    "page_cleaning": (R.page_cleaning, "documents"),
    "chunk_readings": (R.chunk_readings, "chunks"),
    "english_documents": (R.english_documents, "documents"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}
QUERIES = {name: run for name, (run, _) in _BUILT.items()}
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
