"""Queries of structure, cleaning, payload checks and direct answers (survey 2.4, 2.7, 2.10 to 2.14)."""

from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.functions import extract as X
from sijill.functions.dialect import DUCK, SPARK
from sijill.operators import retrieval as R
from sijill.operators import structure as S
from sijill.session import table


def _records(spark, folder):
    return table(spark, folder, "loaded_legal_json")


def numbered_items(spark, folder):
    items = _records(spark, folder).select("record_id", F.inline(S.numbered_items(S.paragraphs(F.col("long_text")))))
    return items.select("record_id", "kind", "number", F.col("paragraph_index").cast("long").alias("paragraph_index"))


def document_sections(spark, folder):
    ps = _records(spark, folder).select("record_id", S.paragraphs(F.col("long_text")).alias("ps"))
    return ps.select("record_id", F.inline(S.sections(F.col("ps")))).select("record_id", "section_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def page_lines(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.explode(S.paragraphs(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(S.is_page_line(F.col("line"))).alias("n_page_lines"))


def summary_only_chunks(spark, folder):
    return table(spark, folder, "chunks").select("row_id", S.summary_only(F.col("text")).alias("summary_only"))


def json_syntax(spark, folder):
    """Whether each payload is complete JSON; null without one."""
    payload = F.col("payload")
    return _records(spark, folder).select("record_id", F.when(payload.isNotNull(), F.try_parse_json(payload).isNotNull()).alias("valid"))


def payload_keys(spark, folder):
    """The top-level keys of payloads that are objects, however wrapped, in order of name."""
    rows = _records(spark, folder).select("record_id", F.explode(F.array(F.expr(SPARK.payload("payload")))).alias("payload")).where("payload IS NOT NULL")
    return rows.select("record_id", F.array_join(F.array_sort(F.json_object_keys("payload")), ",").alias("keys"), F.array_join(S.banned_keys(F.col("payload")), ",").alias("banned"))


def upload_ids(spark, folder):
    """Texts by the id that their content gives them, with how often each was sent."""
    ids = table(spark, folder, "documents").where("text IS NOT NULL").select(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("upload_id"), "doc_id")
    return ids.groupBy("upload_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_sent"))


def direct_answers(spark, folder):
    """Number, year and first sum of each record, as a question for one of them is answered."""
    rows = table(spark, folder, "search_records").where("document_id IS NOT NULL").select("search_id", "document_id", X.number_and_year(F.col("title")).alias("n"))
    texts = _records(spark, folder).where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("long_text", "record_id").alias("t"))
    return rows.join(texts, "document_id").select("search_id", F.col("n.number").alias("number"), F.col("n.year").alias("year"), F.get(X.amounts(F.col("t")), 0).alias("amount"))


def clean_documents(spark, folder):
    return S.clean_documents(table(spark, folder, "documents"), "doc_id", "text")


def semantic_search(spark, folder):
    """The five chunks nearest to each question by hashed embeddings."""
    chunks = S.hash_embeddings(table(spark, folder, "chunks").select("row_id", A.search_tokens(F.col("text")).alias("tokens")), "row_id", "tokens")
    asked = S.hash_embeddings(table(spark, folder, "search_records").where("search_id % 50 = 0").select(F.col("search_id").alias("row_id"), A.search_tokens(F.col("title")).alias("tokens")), "row_id", "tokens")
    return R.vector_top_k(asked, chunks, "row_id", "embedding", "cosine", 5).select("query_id", F.col("vec_id").alias("row_id"), "distance")


QUERIES = {f.__name__: f for f in (numbered_items, document_sections, page_lines, summary_only_chunks, json_syntax, payload_keys, upload_ids, direct_answers, clean_documents, semantic_search)}

_PS = r"list_filter(list_transform(string_split_regex(coalesce({0}, ''), '\n\s*\n|\n'), lambda p: trim(p)), lambda p: p <> '')"
_P = f"p AS (SELECT record_id, {_PS.format('long_text')} AS ps FROM loaded_legal_json), l AS (SELECT record_id, unnest(ps) AS line, generate_subscripts(ps, 1) AS i FROM p)"
_SIGN = rf"length(line) <= 90 AND regexp_matches(translate(regexp_replace(line, '[\x{{064b}}-\x{{065f}}\x{{0670}}\x{{0640}}]+', '', 'g'), 'أإآ', 'ااا'), '{S.SIGNER}')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
SQL = {
    "clean_documents": f"SELECT doc_id, {S.cleaned_text(DUCK, 'text')} AS text FROM documents",
    "numbered_items": f"WITH {_P} SELECT record_id, CASE WHEN regexp_extract(line, '{S.ITEM}', 1) <> '' THEN 'ordinal_item' ELSE 'article_reference' END AS kind, CASE WHEN regexp_extract(line, '{S.ITEM}', 1) <> '' THEN regexp_extract(line, '{S.ITEM}', 1) ELSE trim(regexp_extract(line, '{S.ARTICLE}', 1)) END AS number, i AS paragraph_index FROM l "
    f"WHERE regexp_extract(line, '{S.ITEM}', 1) <> '' OR regexp_extract(line, '{S.ARTICLE}', 1) <> ''",
    "document_sections": f"WITH {_P}, n AS (SELECT record_id, len(ps) AS n FROM p), g AS (SELECT record_id, min(i) AS s FROM l WHERE {_SIGN} GROUP BY 1), b AS (SELECT record_id, min(i) AS a, max(i) AS z FROM l WHERE regexp_extract(line, '{S.ITEM}', 1) <> '' GROUP BY 1) "
    "SELECT record_id, 'header' AS section_id, 1 AS first, least(3, n) AS last FROM n WHERE n > 0 UNION ALL SELECT record_id, 'decision_body', a, z FROM b UNION ALL SELECT record_id, 'signature', greatest(1, s - 1), least(n, s + 1) FROM g JOIN n USING (record_id)",
    "page_lines": f"WITH l AS (SELECT doc_id, unnest({_PS.format('text')}) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '{S.PAGE_NUMBER}') OR regexp_matches(line, '{S.PAGE_COUNTER}')) AS n_page_lines FROM l GROUP BY doc_id",
    "summary_only_chunks": f"SELECT row_id, coalesce(trim(text) <> '' AND len(list_filter({_LIST(S.SUMMARY_MARKERS)}, lambda w: contains(lower(text), lower(w)))) > 0 AND len(list_filter({_LIST(S.SOURCE_MARKERS)}, lambda w: contains(lower(text), lower(w)))) = 0 AND length(text) < 1500, false) AS summary_only FROM chunks",
    "json_syntax": "SELECT record_id, CASE WHEN payload IS NOT NULL THEN json_valid(payload) END AS valid FROM loaded_legal_json",
    "payload_keys": "SELECT record_id, array_to_string(list_sort(json_keys(payload)), ',') AS keys, array_to_string(list_filter(" + _LIST(S.BANNED_KEYS) + r""", lambda k: regexp_matches(payload, '"' || k || '"\s*:')), ',') AS banned FROM (SELECT record_id, """ + DUCK.payload("payload") + " AS payload FROM loaded_legal_json) WHERE payload IS NOT NULL",
    "upload_ids": "SELECT substring(sha256(text), 1, 16) AS upload_id, min(doc_id) AS first_doc, count(*) AS n_sent FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "direct_answers": f"WITH r AS (SELECT document_id, max(record_id) AS record_id FROM loaded_legal_json WHERE document_id IS NOT NULL AND long_text IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT document_id FROM loaded_legal_json WHERE document_id IS NOT NULL), x AS (SELECT k.document_id, l.long_text AS t FROM k LEFT JOIN r USING (document_id) LEFT JOIN loaded_legal_json l ON l.record_id = r.record_id) "
    f"SELECT search_id, nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{X.NUMBER}', 1)''')}, '') AS number, nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{X.YEAR}', 1)''')}, '') AS year, "
    f"trim(regexp_replace(nullif(regexp_extract(coalesce(t, ''), '{X.AMOUNT}'), ''), '\\s+', ' ', 'g')) AS amount FROM search_records JOIN x USING (document_id)",
}
