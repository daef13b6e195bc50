"""Queries of the registry, of upkeep, windows and workflow (survey 2.2 to 2.8, 2.14)."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.operators import registry as R
from sijill.operators.structure import PAGE_NUMBER
from sijill.session import table


def citation_registry_build(spark, folder):
    return R.citations(table(spark, folder, "chunks"))


def law_article_map(spark, folder):
    return R.law_articles(R.citations(table(spark, folder, "chunks")))


def registry_semi(spark, folder):
    return R.registered(table(spark, folder, "citation_registry").select("entry_id", "chunk_id"), table(spark, folder, "chunks"))


def registry_anti(spark, folder):
    return R.unregistered(table(spark, folder, "citation_registry").select("entry_id", "chunk_id"), table(spark, folder, "chunks"))


def registry_warnings(spark, folder):
    """What each entry lacks."""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")).eqNullSafe(""), F.lit(f"missing {c}")) for c in ("law_year", "law_name", "source_file")]))
    return table(spark, folder, "citation_registry").select("entry_id", F.array_join(lacks, "; ").alias("warnings")).where("warnings <> ''")


def dedupe_last_wins(spark, folder):
    chunks = table(spark, folder, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "row_id", "indexed_at", "page_number", "is_deleted")
    return R.last_per_key(chunks, ["chunk_id"], [F.col("indexed_at"), F.col("row_id")]).select("chunk_id", "row_id", "page_number", "is_deleted")


def unique_ids_suffix(spark, folder):
    return R.unique_ids(table(spark, folder, "chunks").where("chunk_id IS NOT NULL").select("row_id", "chunk_id"), "chunk_id", "row_id")


def replace_source_citations(spark, folder):
    """The registry after every source that has chunks was read again: its entries go, one for each chunk comes; other sources' stay."""
    entries = table(spark, folder, "citation_registry").select("source_file", F.trim("chunk_id").alias("chunk_id"))
    fresh = R.citations(table(spark, folder, "chunks")).select("source_file", "chunk_id")
    after = R.upsert(entries.where("source_file IS NOT NULL"), fresh, ["source_file"])
    return after.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("chunk_id").alias("n_chunks"))


def source_statistics(spark, folder):
    return table(spark, folder, "chunks").groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("page_number").alias("pages"), F.sum(F.length("text")).alias("n_chars"), F.count_if("is_deleted").alias("n_deleted"))


def group_concat_sections(spark, folder):
    """The section titles of each document in the order of its chunks; a document's chunks are few by nature."""
    rows = table(spark, folder, "chunks").where("document_id IS NOT NULL AND section_title IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "row_id", "section_title")))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["section_title"]), " > ").alias("sections"))


def carry_forward_article(spark, folder):
    """Each chunk with the last article named up to it in its source."""
    w = W.partitionBy("document_id").orderBy("chunk_index", "row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, folder, "chunks").where("document_id IS NOT NULL").select("row_id", F.last("article_reference", ignorenulls=True).over(w).alias("article"))


def section_islands(spark, folder):
    """Runs of chunks of a document under one section title: title, first and last chunk, length."""
    order = W.partitionBy("document_id").orderBy("chunk_index", "row_id")
    changed = (~F.col("section_title").eqNullSafe(F.lag("section_title").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    rows = table(spark, folder, "chunks").where("document_id IS NOT NULL").select("document_id", "row_id", "chunk_index", "section_title", changed.alias("changed"))
    rows = rows.withColumn("island", F.sum("changed").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy("document_id", "island").agg(F.first("section_title").alias("section_title"), F.count(F.lit(1)).alias("n_chunks"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def item_spans_lead(spark, folder):
    """From which to which chunk each named article of a document reaches."""
    order = W.partitionBy("document_id").orderBy("chunk_index", "row_id")
    items = table(spark, folder, "chunks").where("document_id IS NOT NULL AND article_reference IS NOT NULL").select("row_id", "document_id", "chunk_index", "total_chunks", F.lead("chunk_index").over(order).alias("next"))
    return items.select("row_id", F.col("chunk_index").alias("first_index"), F.greatest("chunk_index", F.coalesce("next", "total_chunks") - 1).alias("last_index"))


def repeated_edge_lines(spark, folder):
    """Lines that stand first or last in at least half, and two, of a source's chunks."""
    rows = table(spark, folder, "chunks").where("text IS NOT NULL AND source_file IS NOT NULL").select("source_file", "row_id", F.split("text", "\n").alias("l"))
    edges = rows.select("source_file", "row_id", F.explode(F.array_distinct(F.array(F.trim(F.element_at("l", 1)), F.trim(F.element_at("l", -1))))).alias("line")).where("line <> ''")
    pages = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pages"))
    counted = edges.groupBy("source_file", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return counted.join(pages, "source_file").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") / 2))).select("source_file", "line", "n")


def repeated_page_edges(spark, folder):
    """Lines among the first three or last two non-blank ones of a source's chunks that most of three or more chunks have (survey 181).

    Each chunk counts once for a line, also a short one whose first and last lines are the
    same; page numbers are left out. repeated_edge_lines looks at one raw line at each end.
    """
    tidy = lambda v: F.trim(F.regexp_replace(v, r"(?U)[\s\x1c-\x1f]+", " "))
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), tidy), lambda v: v != "")
    rows = table(spark, folder, "chunks").where("text IS NOT NULL AND source_file IS NOT NULL").select("source_file", lines.alias("l")).where(F.size("l") > 0)
    last = F.slice("l", F.greatest(F.size("l") - 1, F.lit(1)), 2)
    edges = rows.select("source_file", F.explode(F.array_distinct(F.concat(F.slice("l", 1, 3), last))).alias("line")).where(~F.col("line").rlike(PAGE_NUMBER))
    pages = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 3")
    counted = edges.groupBy("source_file", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return counted.join(pages, "source_file").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") / 2) + 1)).select("source_file", "line", "n")


def merge_layers(spark, folder):
    """Search records and their records' long texts as two layers over one document id."""
    meta = table(spark, folder, "search_records").where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("title", "search_id").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(0.4).cast("double").alias("distance"))
    text = table(spark, folder, "loaded_legal_json").where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("source_file", "record_id").alias("title"), F.max_by("long_text", "record_id").alias("text"), F.lit(0.2).cast("double").alias("distance"))
    return R.merge_layers([("metadata", meta), ("semantic", text)], "document_id").select("document_id", "title", "distance", "layers", F.length("text").cast("long").alias("n_chars"))


def categories_distinct(spark, folder):
    return table(spark, folder, "search_records").select(F.explode("entities").alias("entity")).where("entity IS NOT NULL").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def keyword_filter(spark, folder):
    rows = table(spark, folder, "search_records")
    return rows.where(F.exists("entities", lambda e: F.contains(F.lower(e), F.lit("وزارة")))).select("search_id", "document_type")


def audit_page(spark, folder):
    """The second page of fifty of the newest chunks."""
    return table(spark, folder, "chunks").select("row_id", "source_file", "indexed_at").orderBy(F.desc("indexed_at"), F.desc("row_id")).offset(50).limit(50).select("row_id", "source_file")


def standing_upsert(spark, folder):
    """Deleted chunks as reviews that replace the standing of their id."""
    chunks = table(spark, folder, "chunks").where("chunk_id IS NOT NULL")
    current = chunks.select("chunk_id").distinct().withColumn("status", F.lit("pending"))
    gone = chunks.where("is_deleted").select("chunk_id").distinct().withColumn("status", F.lit("rejected"))
    return R.upsert(current, gone, ["chunk_id"])


def source_text_precedence(spark, folder):
    """Each record's text from the first field of its payload that has any."""
    fields = ["long_text", "body", "full_text", "original_long_text", "original_text", "content", "text"]
    whole = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload"))
    picked = R.first_text(F.col("long_text"), *[F.get_json_object(whole, f"$.{f}") for f in fields])
    return table(spark, folder, "loaded_legal_json").select("record_id", F.length(picked).cast("long").alias("n_chars"), F.md5(picked.cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        citation_registry_build, law_article_map, registry_semi, registry_anti, registry_warnings, dedupe_last_wins, unique_ids_suffix, replace_source_citations, source_statistics,
        group_concat_sections, carry_forward_article, section_islands, item_spans_lead, repeated_edge_lines, repeated_page_edges, merge_layers, categories_distinct,
        keyword_filter, audit_page, standing_upsert, source_text_precedence,
    )
}

_FT = lambda *cs: "coalesce(" + ", ".join(f"nullif(trim({c}), '')" for c in cs) + ", '')"
_CIT = (
    f"SELECT trim(chunk_id) AS chunk_id, {_FT('document_title')} AS law, {_FT('article_reference', 'section_title')} AS article, {_FT('year')} AS law_year, "
    f"array_to_string(list_filter([{_FT('document_title')}, {_FT('article_reference', 'section_title')}], lambda v: v <> ''), ' ') AS legal_reference, page_number, {_FT('document_type', 'block_type')} AS classification, "
    "trim(source_file) AS source_file FROM chunks WHERE trim(coalesce(chunk_id, '')) <> '' AND trim(coalesce(source_file, '')) <> ''"
)
_W = "OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, row_id)"
SQL = {
    "citation_registry_build": _CIT,
    "law_article_map": f"SELECT law, article, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM ({_CIT}) GROUP BY law, article",
    "registry_semi": "SELECT chunk_id, entry_id FROM citation_registry WHERE chunk_id IN (SELECT chunk_id FROM chunks)",
    "registry_anti": "SELECT chunk_id, entry_id FROM citation_registry r WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = r.chunk_id)",
    "registry_warnings": "SELECT * FROM (SELECT entry_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'missing {c}' END" for c in ("law_year", "law_name", "source_file")) + "], lambda v: v IS NOT NULL), '; ') AS warnings FROM citation_registry) WHERE warnings <> ''",
    "dedupe_last_wins": "SELECT chunk_id, row_id, page_number, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, row_id DESC) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1",
    "unique_ids_suffix": "SELECT row_id, chunk_id, CASE WHEN n > 1 THEN chunk_id || '-dup-' || (n - 1) ELSE chunk_id END AS unique_id FROM (SELECT row_id, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) AS n FROM chunks WHERE chunk_id IS NOT NULL)",
    "replace_source_citations": f"WITH f AS (SELECT source_file, chunk_id FROM ({_CIT})), a AS (SELECT source_file, trim(chunk_id) AS chunk_id FROM citation_registry WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT source_file FROM f) UNION ALL SELECT * FROM f) SELECT source_file, count(*) AS n_entries, count(DISTINCT chunk_id) AS n_chunks FROM a GROUP BY source_file",
    "source_statistics": "SELECT source_file, count(*) AS n_chunks, max(page_number) AS pages, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE is_deleted) AS n_deleted FROM chunks GROUP BY source_file",
    "group_concat_sections": "SELECT document_id, string_agg(section_title, ' > ' ORDER BY chunk_index NULLS FIRST, row_id) AS sections FROM chunks WHERE document_id IS NOT NULL AND section_title IS NOT NULL GROUP BY document_id",
    "carry_forward_article": f"SELECT row_id, last_value(article_reference IGNORE NULLS) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS article FROM chunks WHERE document_id IS NOT NULL",
    "section_islands": f"WITH c AS (SELECT *, (section_title IS DISTINCT FROM lag(section_title) {_W} OR row_number() {_W} = 1)::INT AS changed FROM chunks WHERE document_id IS NOT NULL), i AS (SELECT *, sum(changed) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS island FROM c) "
    "SELECT document_id, island, any_value(section_title) AS section_title, count(*) AS n_chunks, min(row_id) AS first_row, max(row_id) AS last_row FROM i GROUP BY document_id, island",
    "item_spans_lead": f"SELECT row_id, chunk_index AS first_index, greatest(chunk_index, coalesce(nxt, total_chunks) - 1) AS last_index FROM (SELECT *, lead(chunk_index) {_W} AS nxt FROM chunks WHERE document_id IS NOT NULL AND article_reference IS NOT NULL)",
    "repeated_edge_lines": "WITH r AS (SELECT source_file, row_id, string_split(text, chr(10)) AS l FROM chunks WHERE text IS NOT NULL AND source_file IS NOT NULL), e AS (SELECT source_file, row_id, unnest(list_distinct([trim(l[1]), trim(l[-1])])) AS line FROM r), p AS (SELECT source_file, count(*) AS n_pages FROM r GROUP BY 1), "
    "c AS (SELECT source_file, line, count(*) AS n FROM e WHERE line <> '' GROUP BY 1, 2) SELECT c.source_file, c.line, c.n FROM c JOIN p USING (source_file) WHERE n >= greatest(2, floor(n_pages / 2))",
    "categories_distinct": "SELECT entity, count(*) AS n FROM (SELECT unnest(entities) AS entity FROM search_records) WHERE entity IS NOT NULL GROUP BY entity",
    "keyword_filter": "SELECT search_id, document_type FROM search_records WHERE len(list_filter(entities, lambda e: contains(lower(e), 'وزارة'))) > 0",
    "audit_page": "SELECT row_id, source_file FROM (SELECT row_id, source_file FROM chunks ORDER BY indexed_at DESC NULLS LAST, row_id DESC LIMIT 50 OFFSET 50)",
    "standing_upsert": "SELECT chunk_id, CASE WHEN bool_or(coalesce(is_deleted, false)) THEN 'rejected' ELSE 'pending' END AS status FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
    "source_text_precedence": "WITH p AS (SELECT record_id, long_text, CASE WHEN json_valid(payload) THEN payload END AS j FROM loaded_legal_json), t AS (SELECT record_id, coalesce(nullif(trim(long_text), ''), "
    + ", ".join(f"nullif(trim(json_extract_string(j, '$.{f}')), '')" for f in ("long_text", "body", "full_text", "original_long_text", "original_text", "content", "text"))
    + ", '') AS t FROM p) SELECT record_id, length(t) AS n_chars, md5(t) AS digest FROM t",
    "merge_layers": "WITH m AS (SELECT document_id, arg_max(title, search_id) AS title FROM search_records WHERE document_id IS NOT NULL GROUP BY 1), tid AS (SELECT document_id, max(record_id) AS record_id FROM loaded_legal_json WHERE document_id IS NOT NULL GROUP BY 1), "
    "ms AS (SELECT s.document_id, s.title FROM search_records s JOIN (SELECT document_id, max(search_id) AS search_id FROM search_records WHERE document_id IS NOT NULL GROUP BY 1) USING (search_id)), t AS (SELECT l.document_id, l.source_file, l.long_text FROM loaded_legal_json l JOIN tid USING (record_id)) "
    "SELECT coalesce(ms.document_id, t.document_id) AS document_id, CASE WHEN ms.document_id IS NOT NULL THEN ms.title ELSE t.source_file END AS title, "
    "CASE WHEN t.document_id IS NULL THEN 0.4 WHEN ms.document_id IS NULL OR trim(coalesce(t.long_text, '')) <> '' THEN 0.2 ELSE 0.2 END::DOUBLE AS distance, CASE WHEN ms.document_id IS NULL THEN 'semantic' WHEN t.document_id IS NULL THEN 'metadata' ELSE 'metadata|semantic' END AS layers, length(t.long_text) AS n_chars FROM ms FULL JOIN t ON ms.document_id = t.document_id",
}
