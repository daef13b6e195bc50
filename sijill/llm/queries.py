"""Queries of the operators for language-model training data."""

from sijill.llm import leakage, lookalikes, mojibake, names, packing, splitting, toxicity

QUERIES = {
    "p2_found": lookalikes.p2_found,
    "p2_classes": lookalikes.p2_classes,
    "p4_found": names.p4_found,
    "p5_found": mojibake.p5_found,
    "p5_restored": mojibake.p5_restored,
    "p7_found": splitting.p7_found,
    "p7_pieces": splitting.p7_pieces,
    "p8_containers": packing.p8_containers,
    "p8_report": packing.p8_report,
    "p9_found": leakage.p9_found,
    "p9_cleaned": leakage.p9_cleaned,
    "p10_found": toxicity.p10_found,
    "p10_scores": toxicity.p10_scores,
    "p10_rates": toxicity.p10_rates,
}

SQL: dict[str, str] = {"p7_found": splitting.P7_SQL, "p9_found": leakage.P9_SQL}
