"""Projections of chunks, payloads and results: ids, keys, labels, search texts (survey 2.3), for both engines."""

from __future__ import annotations

from sijill.functions.dialect import Dialect
from sijill.functions.extract import DATE, RECOMMENDATION_NUMBERS, REFERENCE_NUMBERS, SESSION_DATES

# Generated summaries, chunks' upload prefix, explicit decision numbers.
SUMMARY_LINE = r"^\s*(?:(?i:summary)|ملخص|الملخص|الخلاصة|الشرح التفصيلي|الشرح التفصيلى)\s*[:：\-]?"
SUMMARY_LABELS = ["الشرح التفصيلي", "الشرح التفصيلى"]
UPLOAD_PREFIX = "^uploaded_[0-9a-f]{16}_"
EXPLICIT_DECISION = r"قرار\s+مجلس\s+الوزراء\s+رقم\s*\(?\s*([0-9٠-٩]+)\s*\)?"


def without_summaries(q: Dialect, x: str) -> str:
    """A text without the lines of generated summaries, blanks tidied."""
    kept = q.keep(q.split(q.text(x), r"\r?\n"), "v", f"NOT ({q.match('v', SUMMARY_LINE)} OR {q.any('v', SUMMARY_LABELS)})")
    return tidy(q, q.join(kept, "chr(10)"))


def tidy(q: Dialect, x: str) -> str:
    """Line ends unified, blanks squeezed, at most one empty line."""
    out = q.sub(q.sub(x, r"\r\n?", "\n"), r"[^\S\n]+", " ")
    return q.strip(q.sub(q.sub(out, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def chunk_key(q: Dialect, source: str, index: str) -> str:
    text = "VARCHAR(20)" if q.duck else "STRING"
    return f"substring(sha1({q.text(source)}), 1, 12) || '-chunk-' || CAST({index} AS {text})"


def labelled_key(q: Dialect, document: str, label: str, index: str) -> str:
    text = "VARCHAR(20)" if q.duck else "STRING"
    i = f"CAST({index} AS {text})"
    return f"{document} || '_' || {label} || '_' || {i} || '_' || substring(sha1({document} || '|' || {label} || '|' || {i}), 1, 12)"


def joined(q: Dialect, *xs: str) -> str:
    """Values joined, each once, without blanks at their ends; blank ones left out."""
    return q.join(q.unique(q.keep(q.each(q.list(*[q.text(x) for x in xs]), "v", q.strip("v")), "v", "v <> ''")), " | ")


def source_label(q: Dialect, x: str) -> str:
    """A file's name as readers know it."""
    return f"CASE WHEN lower({q.strip(q.text(x))}) = 'missing' THEN '' ELSE {q.strip(f'replace({q.sub(q.strip(q.text(x)), UPLOAD_PREFIX, '')}, {q.s('_')}, {q.s(' ')})')} END"


def split_values(q: Dialect, x: str) -> str:
    """A scalar that holds several values, apart: by bars and line ends, each once."""
    return q.unique(q.keep(q.each(q.split(q.text(x), r"\s*\|\s*|\n+"), "v", q.strip("v")), "v", "v <> ''"))


def citation(q: Dialect, c: str = "") -> dict[str, str]:
    """The thirteen fields of a chunk row's citation, with their fallbacks; columns that a table lacks are left out."""
    col = lambda name: f"{c}{name}"
    law = q.first(q.text(col("document_title")), q.text(col("source_file")))
    article = q.first(q.text(col("article_reference")))
    year = q.first(q.text(col("year")))
    name = q.first(q.text(col("document_title")), law)
    reference = f"{name} || CASE WHEN {year} <> '' THEN ' لسنة ' || {year} ELSE '' END"
    return {
        "law": law, "article": article, "law_number": "''", "law_year": year, "article_number": "''", "law_name": name, "legal_reference": reference,
        "page_number": f"coalesce({col('page_number')}, 1)", "classification": q.first(q.text(col("document_type"))), "document_type": q.first(q.text(col("document_type"))),
        "source_file": q.strip(q.text(col("source_file"))), "ingest_date": f"CAST(CAST({col('indexed_at')} AS DATE) AS {'VARCHAR' if q.duck else 'STRING'})", "chunk_id": q.strip(q.text(col("chunk_id"))),
    }


def metadata_text(q: Dialect) -> str:
    """What a chunk's metadata adds to the searched text; names of files don't count."""
    fields = ["document_id", "document_title", "document_type", "section_title", "article_reference", "block_type", "year", "source_type"]
    return q.join(q.keep(q.list(*[q.strip(q.text(f)) for f in fields]), "v", "v <> ''"), " ")


def chunk_records(q: Dialect) -> str:
    """Every chunk row's keys, labels and texts as retrieval uses them."""
    dedupe = q.norm(f"coalesce(nullif({q.first(q.text('document_id'), q.text('source_file'), q.text('document_title'))}, ''), {q.cut(q.text('text'), 160)})")
    key = q.first(q.text("document_id"), q.text("source_file"))
    context = joined(q, "document_title", "document_type", "year")
    return (
        f"SELECT row_id, {chunk_key(q, 'source_file', 'coalesce(chunk_index, 0)')} AS chunk_key, {labelled_key(q, q.text('document_id'), q.s('section'), 'coalesce(chunk_index, 0)')} AS labelled_key, {key} AS document_key, {dedupe} AS dedupe_key, {source_label(q, 'source_file')} AS label, "
        f"{metadata_text(q)} AS metadata_text, md5({q.strip(f'{q.text('text')} || chr(10) || {metadata_text(q)}')}) AS candidate_text, md5(CASE WHEN {context} = '' THEN {q.text('text')} ELSE {context} || chr(10) || chr(10) || {q.text('text')} END) AS embedding_text, md5({without_summaries(q, 'text')}) AS without_summaries FROM {q.table('chunks')}"
    )


def search_context(q: Dialect) -> str:
    """The different values by which each record is found, joined, up to the reference's 1,200 characters."""
    fields = [q.text(c) for c in ("title", "document_type", "decision_number", "year", "issue_date", "session_number", "session_date")]
    entities = f"coalesce(entities, {q.keep(q.list(q.s('')), 'v', 'false')})"
    values = q.unique(q.keep(q.concat(q.list(*fields), entities), "v", "v IS NOT NULL AND v <> ''"))
    return f"SELECT search_id, {q.cut(q.join(values, ' | '), 1200)} AS context FROM {q.table('search_records')}"


def chunk_citations(q: Dialect) -> str:
    """The citation of every chunk row that has an id and a source."""
    own = f"SELECT row_id, {', '.join(f'{v} AS {k}' for k, v in citation(q).items())} FROM {q.table('chunks')}"
    return f"SELECT * FROM ({own}) WHERE chunk_id <> '' AND source_file <> ''"


def _payloads(q: Dialect) -> str:
    """Complete payloads, however they are wrapped."""
    # as the one row of a list the payload is unwrapped once, not anew in each expression over it
    rows = f"SELECT record_id, {q.rows(q.list(q.payload('payload')))} AS payload, {q.text('long_text')} AS x FROM {q.table('loaded_legal_json')}"
    return f"SELECT * FROM ({rows}) WHERE payload IS NOT NULL"


def payload_fields(q: Dialect) -> str:
    """Fields of the document object in every payload."""
    return f"SELECT record_id, {', '.join(f'{q.json("payload", f"$.document.{k}")} AS {k}' for k in ('type', 'year', 'session_number'))} FROM ({_payloads(q)})"


def derived(q: Dialect) -> str:
    """What every payload's own fields and its text tell of a decision, fields before text."""
    # a short list per field rather than nested expressions, whose generated code grows too large to compile
    pick = lambda *paths: f"coalesce({q.at(q.keep(q.each(q.list(*[q.text(q.json('payload', f'$.{p}')) for p in paths]), 'v', q.strip('v')), 'v', "v <> ''"), 1)}, '')"
    of = lambda name: [name, f"document.{name}", f"metadata.{name}", f"extracted_fields.{name}"]
    flat = q.sub("x", r"\s+", " ")
    session = "coalesce(" + ", ".join(f"nullif({q.sub(q.find(flat, p, 1), r'\s+', '')}, '')" for p in SESSION_DATES) + ", '')"
    first = lambda patterns: "coalesce(" + ", ".join(f"nullif({q.strip(q.find('x', p, 1))}, '')" for p in patterns) + ", '')"
    spoken = lambda value: f"CASE WHEN lower({value}) IN ('none', 'null') THEN '' ELSE {value} END"
    fields = {
        "decision_number": f"coalesce(nullif({spoken(pick(*of('decision_number')))}, ''), {q.find('x', EXPLICIT_DECISION, 1)})",
        "issue_date": spoken(pick(*of("issue_date"))),
        "session_date": f"coalesce(nullif({spoken(pick(*of('session_date')))}, ''), {session})",
        "session_number": spoken(pick(*of("session_number"))),
        "year": spoken(pick(*of("year"))),
        "reference_numbers": first(REFERENCE_NUMBERS),
        "recommendation_numbers": first(RECOMMENDATION_NUMBERS),
        "dates": q.find("x", DATE),
    }
    return f"SELECT record_id, {', '.join(f'{v} AS {k}' for k, v in fields.items())} FROM ({_payloads(q)})"


# What a generated payload must have, and fields it must not have.
REQUIRED = ["source.filename", "source.extension", "document.type", "document.title", "metadata", "references", "decision.sections", "body", "paragraphs", "legal_entities", "extracted_fields", "signature"]
ENTITY_KEYS = ["ministries", "companies", "committees", "authorities", "government_offices", "people", "projects", "councils"]
FIELD_KEYS = ["money", "percentages", "years", "durations", "pipe_lengths", "diameters", "thickness", "quantities"]
CORE = ["issue_date", "subject", "sender", "signature"]
DATES = ["document.issue_date", "document.session.date", "metadata.issue_date", "metadata.session_date"]
GOVERNMENT = ["schema_version", "id", "source", "metadata", "legal_content", "processing"]


def payload_errors(q: Dialect) -> str:
    """The constraints that each complete payload breaks: fields, lists, sparse metadata, dates, entity and value groups, signature."""
    at = lambda path: q.json("payload", f"$.{path}")
    absent = lambda path: f"({at(path)} IS NULL OR {at(path)} IN ('', 'null'))"
    is_list = lambda path: f"coalesce({q.match(at(path), r'^\s*\[')}, false)"
    is_object = lambda path: f"coalesce({q.match(at(path), r'^\s*\{')}, false)"
    empty = lambda path: f"({absent(path)} OR {q.match(q.text(at(path)), r'^\s*\[\s*\]\s*$')})"
    sparse = " + ".join(f"CASE WHEN {empty('metadata.' + k)} THEN 1 ELSE 0 END" for k in CORE)
    bad_date = lambda path: f"(NOT {absent(path)} AND NOT {q.match(q.strip(q.text(at(path))), '^' + DATE + '$')})"
    rules = [(absent(p), f"missing {p}") for p in REQUIRED]
    rules += [(f"NOT {is_list('paragraphs')} OR {empty('paragraphs')}", "paragraphs must be a non-empty list"), (f"NOT {is_object('metadata')}", "metadata must be an object"), (f"{sparse} >= 4", "metadata is too sparse")]
    rules += [(bad_date(p), f"invalid date {p}") for p in DATES] + [(f"NOT {is_list('decision.sections')}", "decision.sections must be a list"), (f"NOT {is_list('references')}", "references must be a list")]
    rules += [(f"NOT {is_list(f'legal_entities.{k}')}", f"legal_entities.{k} must be a list") for k in ENTITY_KEYS] + [(f"NOT {is_list(f'extracted_fields.{k}')}", f"extracted_fields.{k} must be a list") for k in FIELD_KEYS]
    rules += [(f"NOT {is_object('signature')}", "signature must be an object")] + [(absent(p), f"missing top-level {p}") for p in GOVERNMENT]
    errors = q.keep(q.list(*[f"CASE WHEN {c} THEN {q.s(m)} END" for c, m in rules]), "e", "e IS NOT NULL")
    rows = f"SELECT record_id, {errors} AS errors FROM ({_payloads(q)})"
    return f"SELECT record_id, {q.size('errors')} AS n_errors, {q.join('errors', ' ; ')} AS errors FROM ({rows})"


def uploads(q: Dialect) -> str:
    """Chunks of each file gathered as an upload: pages, chunks, characters and what is missing."""
    page = "coalesce(page_number, 1)"
    return f"SELECT source_file, count(*) AS n_chunks, count(DISTINCT {page}) AS n_pages, CAST(sum(length({q.text('text')})) AS BIGINT) AS n_characters, count(*) - count(text) AS n_empty, min({page}) AS first_page, max({page}) AS last_page FROM {q.table('chunks')} WHERE source_file IS NOT NULL GROUP BY source_file"


# What the other two payload profiles must have.
STANDARD_METADATA, STANDARD_CONTENT = ["title", "document_type", "country", "language", "status"], ["preamble", "articles", "clauses", "full_text"]


def profile_errors(q: Dialect) -> str:
    """The constraints that each complete payload breaks by the government, the unified and the legacy profile."""
    at = lambda path: q.json("payload", f"$.{path}")
    absent = lambda path: f"({q.text(at(path))} IN ('', 'null'))"
    kind = lambda path, mark: f"coalesce({q.match(at(path), mark)}, false)"
    government = [(absent(k), f"Missing top-level field: {k}") for k in GOVERNMENT] + [(f"{kind('metadata', '^ *[{]')} AND {absent('metadata.' + k)}", f"Missing metadata field: {k}") for k in STANDARD_METADATA]
    government += [(f"NOT {kind('legal_content', '^ *[{]')}", "legal_content must be an object"), (f"{q.text(at('metadata.document_type'))} = 'unknown'", "document_type could not be detected")] + [(f"{kind('legal_content', '^ *[{]')} AND {absent('legal_content.' + k)}", f"Missing legal_content field: {k}") for k in STANDARD_CONTENT]
    unified = [(absent("document_classification.category"), "missing document classification category"), (f"NOT {kind('legal_structure.sections', r'^ *\[ *[^\] ]')}", "legal_structure sections are missing"), (f"{absent('document_title')} AND {absent('title')} AND {absent('document_classification.category')}", "missing title"), (absent("cleaned_text"), "cleaned text is empty"), (absent("original_text"), "original text is empty")]
    legacy = [(absent(k), f"missing {k}") for k in ("source", "metadata", "paragraphs")]
    lists = {name: q.keep(q.list(*[f"CASE WHEN {c} THEN {q.s(m)} END" for c, m in rules]), "e", "e IS NOT NULL") for name, rules in (("government", government), ("unified", unified), ("legacy", legacy))}
    return f"SELECT record_id, {', '.join(f'{q.join(v, " ; ")} AS {k}' for k, v in lists.items())} FROM ({_payloads(q)})"


def previews(q: Dialect) -> str:
    """Every record's lines as simple HTML, and whether the numbers that head its lines rise."""
    escaped = "replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    heads = q.each(q.keep(q.each("ps", "p", q.find("p", r"^([0-9]{1,9})[.):-]", 1)), "n", "n <> ''"), "n", "CAST(n AS BIGINT)")
    rising = f"{q.size(q.places('ns', 'i', f'i > 1 AND {q.at('ns', 'i')} < {q.at('ns', 'i - 1')}'))} = 0"
    rows = f"SELECT record_id, ps, {heads} AS ns FROM (SELECT record_id, {q.lines('long_text')} AS ps FROM {q.table('loaded_legal_json')})"
    return f"SELECT record_id, md5({q.join(q.each('ps', 'p', f"'<p>' || {escaped} || '</p>'"), 'chr(10)')}) AS html, {q.size('ns')} AS n_numbered, {rising} AS rising FROM ({rows})"
