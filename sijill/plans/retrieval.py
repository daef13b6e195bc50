"""Queries of search, ranking and answers (survey 2.4 to 2.9, 2.13).

hybrid_rerank, grounded_answers, best_document_per_question and extractive_summary_all
take every search record as a question, the other searches every record whose id is
divisible by 50; all search all rows.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.functions import extract as X
from sijill.functions.dialect import DUCK, column
from sijill.operators import grounded as G
from sijill.operators import questions as Q
from sijill.operators import records as P
from sijill.operators import retrieval as R
from sijill.operators import search as Z
from sijill.session import in_waves, materialize, spread, table, texts


#: Questions that are answered at a time, with the texts they are answered from.
ANSWERED = 20_000


def _questions(spark, folder):
    return table(spark, folder, "search_records").where("search_id % 50 = 0").select(F.col("search_id").alias("query_id"), F.col("title").alias("text"))


def _every_question(spark, folder):
    """Every search record; one without a key names no question."""
    return table(spark, folder, "search_records").where("search_id IS NOT NULL").select(F.col("search_id").alias("query_id"), F.col("title").alias("text"))


def _chunks(spark, folder):
    return texts(spark, folder, "chunks", "row_id", "text").withColumnRenamed("row_id", "doc_id")


def bm25_topk(spark, folder):
    return R.bm25(_questions(spark, folder), _chunks(spark, folder), 10).select("query_id", "doc_id", "score")


def _rows(spark, folder):
    """Chunks as they are searched, with what their metadata add."""
    rows = spread(table(spark, folder, "chunks"))
    meta = column(lambda q, *_: P.metadata_text(q), "row_id")
    key = F.coalesce(F.nullif(F.trim("document_id"), F.lit("")), "source_file", "document_title", F.substring("text", 1, 160))
    return rows.select(F.col("row_id").alias("doc_id"), "text", meta.alias("meta"), F.coalesce("section_title", "article_reference").alias("section"), A.normalize_search(key).alias("document_key"))


def search_every(spark, folder):
    """The flagship: the best five chunks of each question through all layers, every search record being a question."""
    return Z.search(_every_question(spark, folder), _rows(spark, folder))


def hybrid_rerank(spark, folder):
    return search_every(spark, folder)


def grounded_answers(spark, folder):
    """Each question answered from the best document that search finds for it: outright, or by its nearest lines."""
    asked = _every_question(spark, folder)
    chunks = table(spark, folder, "chunks").select(F.col("row_id").alias("doc_id"), "text", F.col("document_title").alias("title"), F.coalesce("document_id", F.lit("")).alias("document_key"))
    best = materialize(search_every(spark, folder), "found")
    latest = table(spark, folder, "search_records").where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("document_key")).agg(*[F.max_by(c, "search_id").alias(c) for c in ("decision_number", "issue_date", "session_date")])
    texts = table(spark, folder, "loaded_legal_json").where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("document_key")).agg(F.max_by("long_text", "record_id").alias("long_text"))

    def answered(some):
        found = best.join(chunks, "doc_id").join(some.select("query_id", column(lambda q, x: Q.needs_several(q, q.norm(x)), "text").alias("several")), "query_id")
        return G.answered(some, G.top_document(found), latest.join(texts, "document_key", "full"))

    return in_waves(asked, "query_id", ANSWERED, answered, "answered")


def metadata_candidates(spark, folder):
    own = Z.asked(_questions(spark, folder))
    return Z.metadata_candidates(own, Z.searched(_rows(spark, folder).select("doc_id", F.col("meta").alias("text")), own)).select("query_id", "doc_id", "score")


def _lexical(spark, folder, questions):
    own = Z.asked(questions)
    return Z.lexical_candidates(own, Z.searched(_chunks(spark, folder), own)).select("query_id", "doc_id", "score")


def lexical_candidates(spark, folder):
    return _lexical(spark, folder, _questions(spark, folder))


def full_text_fallback(spark, folder):
    documents = texts(spark, folder, "loaded_legal_json", "record_id", "long_text").select(F.col("record_id").alias("doc_id"), F.col("long_text").alias("text"))
    return Z.full_text_fallback(_questions(spark, folder), documents).select("query_id", "doc_id", "score")


def result_sources(spark, folder):
    """The sources of each question's ten best chunks by BM25: reference, page, and whether the registry knows them."""
    found = R.bm25(_questions(spark, folder), _chunks(spark, folder), 10)
    rows = table(spark, folder, "chunks").select(F.col("row_id").alias("doc_id"), "chunk_id", "document_title", "source_file", "page_number")
    return Z.sources(found, rows, table(spark, folder, "citation_registry").select("chunk_id", "entry_id", "legal_reference"))


def best_document_per_question(spark, folder):
    """The document of each question's best lexical candidate, the first by name of equals, with how many of its chunks are candidates."""
    owners = table(spark, folder, "chunks").where("document_id IS NOT NULL").select(F.col("row_id").alias("doc_id"), "document_id")
    found = _lexical(spark, folder, _every_question(spark, folder)).join(owners, "doc_id").groupBy("query_id", "document_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_chunks"))
    return R.top_k(found, "query_id", [F.desc("score"), F.asc("document_id")], 1).drop("place")


def lexical_relevance(spark, folder):
    """Each title against the long text of its own record."""
    rows = table(spark, folder, "search_records").where("document_id IS NOT NULL").select("search_id", "document_id", A.normalize_search(F.col("title")).alias("q"))
    texts = table(spark, folder, "loaded_legal_json").where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("long_text", "record_id").alias("t")).select("document_id", A.normalize_search(F.col("t")).alias("d"))
    both = rows.join(texts, "document_id").select("search_id", "q", "d", F.array_distinct(A.search_tokens(F.col("q"), True)).alias("qt"), F.array_distinct(A.search_tokens(F.col("d"), True)).alias("dt"))
    return both.select("search_id", F.round(R.lexical_relevance(F.col("q"), F.col("qt"), F.col("d"), F.col("dt")), 6).alias("score"))


def vector_topk_l2(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return R.vector_top_k(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", "l2").select("query_id", "vec_id", "distance")


def vector_topk_cosine(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return R.vector_top_k(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", "cosine").select("query_id", "vec_id", "distance")


def exact_law_lookup(spark, folder):
    """The record that a question's number and year name: 140 for both, 5 for each shared term, the lowest id of equals."""
    rows = table(spark, folder, "search_records").select("search_id", "title", X.number_and_year(F.col("title")).alias("n"), A.normalize_search(F.col("title")).alias("t"))
    rows = rows.select("search_id", F.col("n.number").alias("number"), F.col("n.year").alias("year"), F.array_distinct(F.filter(F.split("t", " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))).alias("words")).where("number IS NOT NULL AND year IS NOT NULL")
    asked = rows.where("search_id % 50 = 0").select(F.col("search_id").alias("query_id"), "number", "year", F.col("words").alias("asked"))
    scored = asked.join(rows, ["number", "year"]).where("search_id <> query_id").withColumn("score", (140 + 5 * F.size(F.array_intersect("asked", "words"))).cast("long"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "search_id"))).where("place = 1").select("query_id", "search_id", "score")


def _cited(spark, folder):
    chunks = table(spark, folder, "chunks").where("text IS NOT NULL AND chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by("text", "row_id").alias("text"))
    return table(spark, folder, "citation_registry").where("legal_reference IS NOT NULL").select("entry_id", "chunk_id", "legal_reference").join(chunks, "chunk_id")


def supporting_sources(spark, folder):
    """Whether a chunk bears out the reference that its entry states: by a number, else by three shared words."""
    numbers = F.regexp_extract_all("legal_reference", F.lit("[0-9٠-٩][0-9٠-٩.,/]*"), F.lit(0))
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_\x{0600}-\x{06ff}]+"), F.lit(0)), lambda w: F.length(w) > 2))
    rows = _cited(spark, folder).select("entry_id", F.exists(numbers, lambda n: F.contains(F.col("text"), n)).alias("by_number"), F.size(words(F.col("legal_reference"))).alias("n"), F.size(F.array_intersect(words(F.col("legal_reference")), words(F.col("text")))).alias("shared"))
    return rows.select("entry_id", (F.col("by_number") | ((F.col("n") > 0) & (F.col("shared") >= F.least(F.lit(3), F.col("n"))))).alias("supported"))


def answer_number_validation(spark, folder):
    """Numbers of each reference that its chunk has neither so nor reversed."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(A.fold_digits(c), F.lit("[0-9]+"), F.lit(0)))
    seen = numbers(F.col("text"))
    missing = F.array_except(F.array_except(numbers(F.col("legal_reference")), seen), F.transform(seen, F.reverse))
    return _cited(spark, folder).select("entry_id", F.array_join(F.array_sort(missing), ",").alias("unsupported"))


def _summaries(spark, folder, rows):
    """The three lines of a record's text nearest to its title, by shared tokens; equals by their place."""
    asked = rows.where("document_id IS NOT NULL").select("search_id", "document_id", F.array_distinct(A.search_tokens(F.col("title"))).alias("q"))
    texts = table(spark, folder, "loaded_legal_json").where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("long_text", "record_id").alias("t"))
    lines = asked.join(texts, "document_id").select("search_id", "q", F.posexplode(F.split("t", "\n")).alias("line_no", "line")).where("length(trim(line)) >= 12")
    scored = lines.withColumn("score", F.round(F.size(F.array_intersect("q", F.array_distinct(A.search_tokens(F.col("line"))))) / F.nullif(F.size("q"), F.lit(0)), 6)).where("score > 0")
    best = scored.groupBy("search_id", F.trim("line").alias("line")).agg(F.max("score").alias("score"), F.min("line_no").alias("line_no"))
    return R.top_k(best, "search_id", [F.desc("score"), F.asc("line_no")], 3).select("search_id", "line", "score")


def extractive_summary(spark, folder):
    return _summaries(spark, folder, table(spark, folder, "search_records").where("search_id % 50 = 0"))


def extractive_summary_all(spark, folder):
    """extractive_summary for every search record."""
    return _summaries(spark, folder, table(spark, folder, "search_records"))


QUERIES = {f.__name__: f for f in (bm25_topk, hybrid_rerank, grounded_answers, metadata_candidates, lexical_candidates, best_document_per_question, full_text_fallback, result_sources, lexical_relevance, vector_topk_l2, vector_topk_cosine, exact_law_lookup, supporting_sources, answer_number_validation, extractive_summary, extractive_summary_all)}

_Q = f"q AS (SELECT search_id AS query_id, unnest({A.search_tokens_sql('title')}) AS term FROM search_records WHERE search_id % 50 = 0)"
_CITED = "c AS (SELECT chunk_id, arg_max(text, row_id) AS text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id), j AS (SELECT entry_id, legal_reference, text FROM citation_registry JOIN c USING (chunk_id) WHERE legal_reference IS NOT NULL)"
_LAST = "x AS (SELECT l.document_id, l.long_text AS t FROM loaded_legal_json l JOIN (SELECT document_id, max(record_id) AS record_id FROM loaded_legal_json WHERE document_id IS NOT NULL AND long_text IS NOT NULL GROUP BY 1) USING (record_id))"
_WORDS = r"list_distinct(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06ff}}]+'), lambda w: length(w) > 2))"
_VEC = "SELECT query_id, vec_id, distance FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS n FROM (SELECT q.vec_id AS query_id, v.vec_id, round({0}, 4) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE n <= 10"
_NUM = f"list_distinct(regexp_extract_all({A.fold_digits_sql('{0}')}, '[0-9]+'))"
_LEXICAL, _LEXICAL_ALL = (Z.lexical_sql(w, "SELECT row_id AS doc_id, text FROM chunks") for w in ("search_id % 50 = 0", "search_id IS NOT NULL"))
SQL = {
    "best_document_per_question": f"WITH l AS ({_LEXICAL_ALL}), g AS (SELECT query_id, document_id, max(score) AS score, count(*) AS n_chunks FROM l JOIN chunks ON doc_id = row_id WHERE document_id IS NOT NULL GROUP BY 1, 2) SELECT query_id, document_id, score, n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS p FROM g) WHERE p = 1",
    "metadata_candidates": Z.metadata_sql("search_id % 50 = 0", f"SELECT row_id AS doc_id, {P.metadata_text(DUCK)} AS meta FROM chunks"),
    "lexical_candidates": _LEXICAL,
    "bm25_topk": f"WITH {_Q}, a AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY 1, 2), d AS (SELECT row_id AS doc_id, {A.search_tokens_sql('text')} AS tokens FROM chunks), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d), "
    "p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), "
    f"r AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * ({1 - R.B} + {R.B} * dl / avgdl))) AS raw FROM p JOIN f USING (term) JOIN a USING (term), s GROUP BY 1, 2), "
    "z AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM r) SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM z) WHERE n <= 10",
    "lexical_relevance": f"WITH {_LAST.replace(' AND long_text IS NOT NULL', '')}, b AS (SELECT search_id, {A.normalize_search_sql('title')} AS q, {A.normalize_search_sql('t')} AS d FROM search_records JOIN x USING (document_id)), "
    f"k AS (SELECT *, list_distinct({A.search_tokens_sql('q', True)}) AS qt, list_distinct({A.search_tokens_sql('d', True)}) AS dt FROM b), w AS (SELECT *, list_sum(list_transform(qt, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN 3.0 ELSE 1.0 END)) AS total, "
    "coalesce(list_sum(list_transform(list_filter(qt, lambda t: list_contains(dt, t)), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN 3.0 ELSE 1.0 END)), 0) AS hit FROM k) "
    "SELECT search_id, coalesce(round(CASE WHEN total > 0 THEN least(hit::DOUBLE / total::DOUBLE + CASE WHEN length(q) >= 8 AND contains(d, q) THEN 0.2 ELSE 0.0 END, 1.0) END, 6), 0.0)::DOUBLE AS score FROM w",
    "vector_topk_l2": _VEC.format("pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2)"),
    "vector_topk_cosine": _VEC.format("greatest(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0)"),
    "exact_law_lookup": f"WITH r AS (SELECT search_id, nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{X.NUMBER}', 1)''')}, '') AS number, nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{X.YEAR}', 1)''')}, '') AS year, "
    f"list_distinct(list_filter(string_split({A.normalize_search_sql('title')}, ' '), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+'))) AS words FROM search_records), "
    "p AS (SELECT a.search_id AS query_id, b.search_id, 140 + 5 * len(list_intersect(a.words, b.words)) AS score FROM r a JOIN r b ON a.number = b.number AND a.year = b.year WHERE a.search_id % 50 = 0 AND a.search_id <> b.search_id) "
    "SELECT query_id, search_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, search_id) AS n FROM p) WHERE n = 1",
    "supporting_sources": f"WITH {_CITED}, k AS (SELECT entry_id, len(list_filter(regexp_extract_all(legal_reference, '[0-9٠-٩][0-9٠-٩.,/]*'), lambda n: contains(text, n))) > 0 AS by_number, {_WORDS.format('legal_reference')} AS a, {_WORDS.format('text')} AS b FROM j) "
    "SELECT entry_id, by_number OR (len(a) > 0 AND len(list_intersect(a, b)) >= least(3, len(a))) AS supported FROM k",
    "answer_number_validation": f"WITH {_CITED}, k AS (SELECT entry_id, {_NUM.format('legal_reference')} AS a, {_NUM.format('text')} AS b FROM j) SELECT entry_id, array_to_string(list_sort(list_filter(a, lambda n: NOT list_contains(b, n) AND NOT list_contains(b, reverse(n)))), ',') AS unsupported FROM k",
    "extractive_summary": f"WITH {_LAST.replace(' AND long_text IS NOT NULL', '')}, a AS (SELECT search_id, document_id, list_distinct({A.search_tokens_sql('title')}) AS q FROM search_records WHERE search_id % 50 = 0), s AS (SELECT search_id, q, string_split(t, chr(10)) AS ls FROM a JOIN x USING (document_id)), "
    "l AS (SELECT search_id, q, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM s), "
    f"k AS (SELECT search_id, trim(line) AS line, no, round(len(list_intersect(q, list_distinct({A.search_tokens_sql('line')})))::DOUBLE / len(q), 6) AS score FROM l WHERE length(trim(line)) >= 12), b AS (SELECT search_id, line, max(score) AS score, min(no) AS no FROM k WHERE score > 0 GROUP BY 1, 2) "
    "SELECT search_id, line, score FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, no) AS n FROM b) WHERE n <= 3",
}
SQL["full_text_fallback"] = Z.fallback_sql("search_id % 50 = 0")
SQL["result_sources"] = (
    f"WITH b AS ({SQL['bm25_topk']}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM b), r AS (SELECT chunk_id, arg_max(legal_reference, entry_id) FILTER (WHERE legal_reference IS NOT NULL) AS any_reference, max(entry_id) AS entry_id FROM citation_registry WHERE chunk_id IS NOT NULL GROUP BY 1), "
    "l AS (SELECT r.chunk_id, c.legal_reference FROM r JOIN citation_registry c USING (entry_id)) SELECT t.query_id, t.place, k.chunk_id, coalesce(nullif(trim(l.legal_reference), ''), nullif(trim(k.document_title), ''), nullif(trim(k.source_file), ''), '') AS label, k.page_number, l.chunk_id IS NOT NULL AS registered FROM t JOIN chunks k ON k.row_id = t.doc_id LEFT JOIN l ON l.chunk_id = k.chunk_id"
)
# a title without tokens shares none
SQL["extractive_summary_all"] = SQL["extractive_summary"].replace("WHERE search_id % 50 = 0", "").replace("length(trim(line)) >= 12", "length(trim(line)) >= 12 AND len(q) > 0")
