"""Payloads: built from what the readers find, checked element by element, repaired, and read out of model replies (survey 2.3, 2.10, 2.12, 2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.dialect import SPARK, Dialect
from sijill.operators import decisions as D
from sijill.operators import nested as N

#: Version of the payloads built here.
VERSION = "legal_document.v2"
# Windows-1252's characters beyond Latin-1 and the bytes they stand for.
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = "".join(chr(b) for b in (*range(0x80, 0x81), *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F))
_ARABIC = r"[\x{0600}-\x{06ff}]"
#: Fields that a model may fill where the rules found nothing.
FILLED = ["legal_references", "responsibilities", "outcome", "affected"]


def standard_payloads(documents: DataFrame) -> DataFrame:
    """(record_id, payload): each document's JSON with source, document, metadata, decision, references, values and signature. documents: record_id, source_file, long_text."""
    spark = documents.sparkSession
    documents.createOrReplaceTempView(SPARK.table("loaded_legal_json"))
    meta, values, content, spans = (spark.sql(s(SPARK)) for s in (D.metadata, D.field_values, D.content, D.legal_spans))
    # a document's spans are some of its own lines
    parts = spans.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "label", "text"))).alias("sections"))
    rows = documents.select("record_id", "source_file", "long_text").join(meta, "record_id").join(values, "record_id").join(content, "record_id").join(parts, "record_id", "left")
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r" \| "), lambda v: v != "")
    items = F.filter("sections", lambda s: s["label"] == "item")
    name = lambda i: F.nullif(F.get(F.split("signature", " - ", 2), F.lit(i)), F.lit(""))
    whole = F.struct(
        F.lit(VERSION).alias("schema_version"),
        F.struct(F.col("source_file").alias("filename"), F.lower(F.regexp_extract("source_file", r"\.([^.]+)$", 1)).alias("extension")).alias("source"),
        F.struct(F.get(F.split(F.trim("long_text"), "\n"), F.lit(0)).alias("title"), F.col("document_number").alias("decision_number"), F.col("document_year").alias("year"), "issue_date", "session_number", "session_date").alias("document"),
        F.struct("ministry", "department", "subject", "sender", "recipient", "reference_number", "issue_date", "session_date", "signature", listed(F.col("attachments")).alias("attachments"), listed(F.col("distribution")).alias("distribution_list")).alias("metadata"),
        F.struct(F.transform(F.coalesce("sections", F.array().cast("array<struct<first:bigint,last:bigint,label:string,text:string>>")), lambda s, i: F.struct((i + 1).alias("id"), s["text"].alias("text"), F.sequence(s["first"], s["last"]).alias("paragraph_indexes"))).alias("sections"), F.transform(F.coalesce(items, F.array().cast("array<struct<first:bigint,last:bigint,label:string,text:string>>")), lambda s: s["text"]).alias("numbered_items"), "outcome").alias("decision"),
        F.transform(listed(F.col("legal_references")), lambda v: F.struct(F.lit("legal_reference").alias("type"), v.alias("text"))).alias("references"),
        F.struct(listed(F.col("affected")).alias("affected"), listed(F.col("responsibilities")).alias("responsible")).alias("legal_entities"),
        F.struct(*[listed(F.col(k)).alias(k) for k in [*D.FIELDS, "years"]]).alias("extracted_fields"),
        F.struct(F.col("signature").alias("text"), name(0).alias("name"), name(1).alias("title")).alias("signature"),
        F.col("long_text").alias("body"),
    )
    return rows.select("record_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def filled(content: DataFrame, replies: DataFrame) -> DataFrame:
    """Fields that the rules left empty from a model's reply, with where each came from. Both: record_id and FILLED."""
    named = replies.select("record_id", *[F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in FILLED])
    rows = content.join(named, "record_id", "left")
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    source = [F.when(own(c).isNotNull(), "rules").when(F.col(f"_{c}").isNotNull(), "model").alias(f"{c}_source") for c in FILLED]
    return rows.select("record_id", *[F.coalesce(own(c), f"_{c}").alias(c) for c in FILLED], *source)


def element_errors(records: DataFrame) -> DataFrame:
    """(record_id, child_table, n_elements, n_empty, n_missing): sections and items of each payload without text, or with text that the record's own doesn't hold. records: record_id, payload, long_text."""
    rows = N.nested_rows(records, "record_id", "payload").where(F.col("child_table").isin("section", "legal_item"))
    texts = N.child_rows(rows, "section").select("record_id", F.lit("section").alias("child_table"), "text").unionByName(N.child_rows(rows, "legal_item").select("record_id", F.lit("legal_item").alias("child_table"), "text"))
    joined = texts.join(records.select("record_id", F.coalesce("long_text", F.lit("")).alias("long_text")), "record_id")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return joined.groupBy("record_id", "child_table").agg(F.count(F.lit(1)).alias("n_elements"), F.count_if(blank).alias("n_empty"), F.count_if(~blank & ~F.contains("long_text", F.col("text"))).alias("n_missing"))


def repaired(col: Column, rounds: int = 3) -> Column:
    """Text that was UTF-8 read as Latin-1 or Windows-1252, up to so many times, set right: the form with most Arabic letters, the earliest of equals."""
    arabic = lambda c: F.size(F.regexp_extract_all(c, F.lit(_ARABIC), F.lit(0)))
    forms, last = [F.struct(arabic(col).alias("n"), F.lit(0).alias("k"), col.alias("t"))], col
    for k in range(1, rounds + 1):
        narrow = F.translate(last, _WINDOWS, _BYTES)
        bytes_ = F.when(narrow.rlike(r"^[\x{00}-\x{ff}]*$") & narrow.rlike(r"[\x{c0}-\x{ff}]"), F.encode(F.regexp_replace(narrow, r"[^\x{00}-\x{ff}]", ""), "ISO-8859-1").cast("string"))
        last = F.when(F.is_valid_utf8(bytes_), bytes_)
        forms.append(F.when(last.isNotNull(), F.struct(arabic(last).alias("n"), F.lit(-k).alias("k"), last.alias("t"))))
    return F.array_max(F.array_compact(F.array(*forms)))["t"]


def embedded_json(q: Dialect, x: str) -> str:
    """The JSON object inside a model's reply, null without a whole one."""
    inner = q.find(q.text(x), r"\{[\s\S]*\}")
    return f"CASE WHEN {inner} <> '' AND {q.valid(inner)} THEN {inner} END"


def parse_metrics(q: Dialect) -> str:
    """Counts of every record's lines, items, characters and words, and whether it could be read."""
    from sijill.operators.structure import ITEM

    rows = f"SELECT record_id, {q.text('long_text')} AS x, {q.lines('long_text')} AS ps FROM {q.table('loaded_legal_json')}"
    return f"SELECT record_id, {q.size('ps')} AS n_paragraphs, {q.size(q.keep('ps', 'p', q.match('p', ITEM)))} AS n_items, CAST(length(x) AS BIGINT) AS n_characters, {q.size(q.all('x', r'[\p{L}\p{N}_]+'))} AS n_words, x <> '' AND {q.size('ps')} > 0 AS valid FROM ({rows})"


def decision_gaps(q: Dialect) -> str:
    """The fields of every record that the rules leave to a model."""
    flags = q.keep(q.list(*[f"CASE WHEN {q.text(f'CAST({c} AS {"VARCHAR" if q.duck else "STRING"})')} = '' THEN '{c}' END" for c in FILLED]), "c", "c IS NOT NULL")
    return f"SELECT record_id, {q.join(flags, ' ')} AS missing FROM ({D.content(q)})"


PREFIXES = "المادة|الشرح التفصيلي|الأسباب الموجبة|الهيكل التنظيمي|العنوان|أولًا|أولاً|ثانيًا|ثانياً"
LABEL = r"^(?:المادة\s*\([^)]+\)(?:\s*-\s*[^:]+)?|الشرح التفصيلي|الأسباب الموجبة|الهيكل التنظيمي|العنوان)\s*:\s*"


def telling_lines(q: Dialect) -> str:
    """The line of every record that says most about each of its titles: shared words, and what its label is worth."""
    from sijill.operators.answers import TITLE_ONLY

    words = lambda x: q.unique(q.all(x, r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"))
    records = f"SELECT document_id, max(long_text) AS t FROM {q.table('loaded_legal_json')} WHERE document_id IS NOT NULL GROUP BY document_id"
    own = "length(w) > 2"
    base = f"SELECT s.search_id, {q.keep(words(q.text('s.title')), 'w', own)} AS qs, {q.lines('l.t')} AS ls FROM {q.table('search_records')} s JOIN ({records}) l ON s.document_id = l.document_id"
    lines = f"SELECT search_id, qs, ls, {q.rows(q.places('ls', 'i', q.match(q.at('ls', 'i'), f'^(?:{PREFIXES})')))} AS i FROM ({base})"
    told = f"SELECT search_id, qs, i, {q.at('ls', 'i')} AS line, {q.strip(q.sub(q.at('ls', 'i'), LABEL, ''))} AS content FROM ({lines})"
    worth = f"CASE WHEN {q.match('line', '^(?:أولًا|أولاً)')} THEN 8 WHEN {q.match('line', '^(?:ثانيًا|ثانياً)')} THEN 4 WHEN {q.match('line', '^المادة')} THEN 2 ELSE 0 END"
    scored = f"SELECT search_id, i, content, {q.size(q.both('qs', words('line')))} + {worth} AS score FROM ({told}) WHERE content <> '' AND NOT {q.match('content', TITLE_ONLY)} AND NOT {q.match('line', TITLE_ONLY)}"
    best = f"SELECT search_id, content, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, i) AS place FROM ({scored})"
    return f"SELECT search_id, content, score FROM ({best}) WHERE place = 1"
