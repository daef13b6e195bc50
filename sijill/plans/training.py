"""Queries of the general training-data operators (problems 1, 3 and 6)."""

from sijill.operators import nested, orphans, timestamps

QUERIES = {
    "p1_found": timestamps.p1_found,
    "p3_found": nested.p3_found,
    "p3_variants": nested.p3_variants,
    "p3_subtypes": nested.p3_subtypes,
    "p3_sections": nested.p3_sections,
    "p3_entities": nested.p3_entities,
    "p3_legal_items": nested.p3_legal_items,
    "p3_references": nested.p3_references,
    "p6_found": orphans.p6_found,
    "p6_report": orphans.p6_report,
}

SQL = {
    "p6_found": orphans.P6_SQL,
    "p6_report": f"SELECT table_name, period, kind, count(*) AS n_rows FROM ({orphans.P6_SQL}) GROUP BY ALL",
}
