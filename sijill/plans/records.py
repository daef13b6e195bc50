"""Queries of record projections, law records and payload checks (survey 2.3, 2.11, 2.12)."""

from sijill.functions.dialect import query
from sijill.operators import lawrecords as L
from sijill.operators import records as R

_ALL = {
    "law_records": (L.law_records, "loaded_legal_json"),
    "government_records": (L.government_records, "loaded_legal_json"),
    "chunk_records": (R.chunk_records, "chunks"),
    "chunk_citations": (R.chunk_citations, "chunks"),
    "derived_metadata": (R.derived, "loaded_legal_json"),
    "payload_errors": (R.payload_errors, "loaded_legal_json"),
    "search_record_context": (R.search_context, "search_records"),
    "payload_metadata": (R.payload_fields, "loaded_legal_json"),
    "profile_errors": (R.profile_errors, "loaded_legal_json"),
    "record_previews": (R.previews, "loaded_legal_json"),
    "upload_summaries": (R.uploads, "chunks"),
}
_BUILT = {name: query(*parts) for name, parts in _ALL.items()}
QUERIES = {name: run for name, (run, _) in _BUILT.items()}
SQL = {name: sql for name, (_, sql) in _BUILT.items()}
