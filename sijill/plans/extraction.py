"""Queries of extraction, classification and validation (survey 2.11, 2.12)."""

from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.functions import extract as X
from sijill.session import spread, table


def _join(col):
    return F.array_join(col, " | ")


def _records(spark, folder):
    return table(spark, folder, "loaded_legal_json")


def extract_dates(spark, folder):
    return _records(spark, folder).select("record_id", _join(X.dates(F.col("payload"))).alias("dates"))


def extract_amounts(spark, folder):
    return spread(table(spark, folder, "chunks")).select("row_id", _join(X.amounts(F.col("text"))).alias("amounts"))


def extract_numbers(spark, folder):
    text = F.col("payload")
    return _records(spark, folder).select("record_id", _join(X.numbers_by(text, X.REFERENCE_NUMBERS)).alias("reference_numbers"), _join(X.numbers_by(text, X.RECOMMENDATION_NUMBERS)).alias("recommendation_numbers"))


def extract_entities(spark, folder):
    return spread(table(spark, folder, "chunks")).select("row_id", _join(X.entities(F.col("text"))).alias("entities"))


def title_number_year(spark, folder):
    return table(spark, folder, "search_records").select("search_id", X.number_and_year(F.col("title")).alias("n")).select("search_id", "n.number", "n.year")


def typed_references(spark, folder):
    refs = X.typed_references(F.concat_ws("\n", "title", "reference_texts"))
    return table(spark, folder, "search_records").select("search_id", refs.alias("r")).select("search_id", *[_join(F.col(f"r.{k}")).alias(k) for k in X.REFERENCES])


def entity_categories(spark, folder):
    return spread(table(spark, folder, "chunks")).select("row_id", X.entity_categories(F.col("text")).alias("e")).select("row_id", *[_join(F.col(f"e.{k}")).alias(k) for k in X.ENTITIES])


def paragraph_types(spark, folder):
    lines = spread(table(spark, folder, "chunks")).select("row_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "paragraph"))
    return lines.groupBy(X.paragraph_type(F.col("paragraph")).alias("paragraph_type")).agg(F.count(F.lit(1)).alias("n_paragraphs"))


def document_types(spark, folder):
    folded = spread(table(spark, folder, "documents")).select("doc_id", X.fold_letters(F.col("text")).alias("folded"))
    return folded.select("doc_id", X.document_type(F.col("folded")).alias("d")).select("doc_id", "d.type", "d.confidence")


def government_types(spark, folder):
    return table(spark, folder, "search_records").select("search_id", X.government_type(F.col("filename"), F.col("title")).alias("type"), X.authority(F.col("title")).alias("authority"))


def government_types_text(spark, folder):
    """Type and authority of each record by its file's name and its whole document's text; government_types reads titles only."""
    return _records(spark, folder).select("record_id", X.government_type(F.col("source_file"), F.col("long_text")).alias("type"), X.authority(F.col("long_text")).alias("authority"))


def date_validity(spark, folder):
    return table(spark, folder, "decision_metadata").select("decision_id", X.valid_date(F.col("issue_date")).alias("valid"))


def validate_errors(spark, folder):
    """The constraints that each decision's metadata breaks, in order."""
    core = ["document_number", "issue_date", "ministry", "subject"]
    absent = sum((F.coalesce(F.trim(F.col(c)), F.lit("")).eqNullSafe("").cast("int") for c in core), F.lit(0))
    bad = [
        (F.col("filename").isNull(), "missing filename"),
        (absent >= 4, "missing metadata"),
        (X.valid_date(F.col("issue_date")) == F.lit(False), "invalid issue_date"),
        (F.col("document_type").isNull(), "missing document_type"),
        (F.col("signature").isNull(), "missing signature"),
    ]
    errors = F.array_compact(F.array(*[F.when(c, m) for c, m in bad]))
    return table(spark, folder, "decision_metadata").select("decision_id", _join(errors).alias("errors"), F.size(errors).cast("long").alias("n_errors"))


def paragraph_coverage(spark, folder):
    """Whether all lines of a chunk's text occur in its record's long text; chunks without a record are not covered."""
    records = _records(spark, folder).where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("long_text", "record_id").alias("long_text"))
    lines = F.filter(F.split("text", "\r?\n"), lambda v: F.trim(v) != "")
    return (
        spread(table(spark, folder, "chunks")).where("text IS NOT NULL").join(records, "document_id", "left")
        .select("row_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(F.filter(lines, lambda v: F.contains(F.col("long_text"), v))), F.lit(0)).cast("long").alias("n_covered"))
        .select("row_id", "n_lines", F.when(F.col("n_covered") >= 0, F.col("n_covered")).otherwise(F.lit(0)).alias("n_covered"))
    )


QUERIES = {f.__name__: f for f in (extract_dates, extract_amounts, extract_numbers, extract_entities, title_number_year, typed_references, entity_categories, paragraph_types, document_types, government_types, government_types_text, date_validity, validate_errors, paragraph_coverage)}


def _all(x, p, g=0):
    return f"regexp_extract_all(coalesce({x}, ''), '{p}', {g})"


def _str(x):
    return f"array_to_string({x}, ' | ')"


def _numbers(x, patterns):
    return _str("list_concat(" + ", ".join(f"list_transform({_all(x, p, 1)}, lambda v: trim(v))" for p in patterns) + ")") if len(patterns) == 2 else _str(f"list_concat(list_concat({', '.join(f'list_transform({_all(x, p, 1)}, lambda v: trim(v))' for p in patterns[:2])}), list_transform({_all(x, patterns[2], 1)}, lambda v: trim(v)))")


_FOLD = r"regexp_replace(translate(regexp_replace(coalesce({0}, ''), '[\x{{064b}}-\x{{065f}}\x{{0670}}\x{{0640}}]', '', 'g'), 'أإآى', 'اااي'), '\s+', ' ', 'g')"


def _contains(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_PARA = "CASE " + " ".join(f"WHEN {_contains('f', w)} THEN '{n}'" for n, w in X.PARAGRAPH_TYPES) + r" WHEN regexp_matches(p, '(?:قانون|قرار|المادة|تعليمات|نظام)\s*(?:رقم)?\s*\(?\s*[0-9٠-٩]+') THEN 'Legal Reference' ELSE 'Paragraph' END"
_HITS = {n: "(" + " + ".join(f"contains(f, '{w.translate(str.maketrans('أإآى', 'اااي'))}')::INT" for w in words) + ")" for n, words, _ in X.TYPE_RULES}
_RULES = ", ".join(f"CASE WHEN {_HITS[n]} > 0 THEN {{'confidence': round(least({b} + 0.04 * ({_HITS[n]} - 1), 0.98), 4)::DOUBLE, 'o': {-i}, 'type': '{n}'}} END" for i, (n, _, b) in enumerate(X.TYPE_RULES))
_VALID = r"CASE WHEN {0} IS NOT NULL THEN coalesce(regexp_full_match({1}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AND try_strptime({1}, '%d/%m/%Y') IS NOT NULL, false) END"
_ISSUE = _VALID.format("issue_date", rf"regexp_replace({A.fold_digits_sql('issue_date')}, '\s+', '', 'g')")

SQL = {
    "extract_dates": f"SELECT record_id, {_str(_all('payload', r'(?:^|[^\p{L}\p{N}_])(' + X.DATE + r')(?:$|[^\p{L}\p{N}_])', 1))} AS dates FROM loaded_legal_json",
    "extract_amounts": f"SELECT row_id, {_str(f'''list_transform({_all('text', X.AMOUNT)}, lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g')))''')} AS amounts FROM chunks",
    "extract_numbers": f"SELECT record_id, {_numbers('payload', X.REFERENCE_NUMBERS)} AS reference_numbers, {_numbers('payload', X.RECOMMENDATION_NUMBERS)} AS recommendation_numbers FROM loaded_legal_json",
    "extract_entities": f"SELECT row_id, {_str(f'''list_filter(list_transform({_all('text', X.ENTITY)}, lambda v: trim(regexp_replace(regexp_replace(v, '(?s)[،؛:.\\n\\r].*$', ''), '\\s+', ' ', 'g'))), lambda v: v <> '')''')} AS entities FROM chunks",
    "title_number_year": f"SELECT search_id, nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{X.NUMBER}', 1)''')}, '') AS number, nullif({A.fold_digits_sql(f'''regexp_extract(coalesce(title, ''), '{X.YEAR}', 1)''')}, '') AS year FROM search_records",
    "typed_references": "WITH t AS (SELECT search_id, concat_ws(chr(10), title, reference_texts) AS x FROM search_records) SELECT search_id, " + ", ".join(f"{_str(f'list_transform({_all('x', p)}, lambda v: trim(v))')} AS {k}" for k, p in X.REFERENCES.items()) + " FROM t",
    "paragraph_types": f"WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM chunks), m AS (SELECT p, {_FOLD.format('p')} AS f FROM l) SELECT {_PARA} AS paragraph_type, count(*) AS n_paragraphs FROM m GROUP BY 1",
    "document_types": f"WITH t AS (SELECT doc_id, {_FOLD.format('text')} AS f FROM documents), b AS (SELECT doc_id, list_max(list_filter([{_RULES}], lambda v: v IS NOT NULL)) AS m FROM t) SELECT doc_id, coalesce(m.type, 'Unknown') AS type, coalesce(m.confidence, 0.0::DOUBLE) AS confidence FROM b",
    "government_types": "WITH t AS (SELECT search_id, coalesce(title, '') AS x, lower(coalesce(filename, '') || chr(10) || substring(coalesce(title, ''), 1, 3000)) AS h FROM search_records) SELECT search_id, CASE " + " ".join(f"WHEN {_contains('h', w)} THEN '{n}'" for n, w in X.GOVERNMENT_TYPES) + " ELSE 'unknown' END AS type, CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in X.AUTHORITIES) + " END AS authority FROM t",
    "government_types_text": "WITH t AS (SELECT record_id, coalesce(long_text, '') AS x, lower(coalesce(source_file, '') || chr(10) || substring(coalesce(long_text, ''), 1, 3000)) AS h FROM loaded_legal_json) SELECT record_id, CASE " + " ".join(f"WHEN {_contains('h', w)} THEN '{n}'" for n, w in X.GOVERNMENT_TYPES) + " ELSE 'unknown' END AS type, CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in X.AUTHORITIES) + " END AS authority FROM t",
    "date_validity": f"SELECT decision_id, {_ISSUE} AS valid FROM decision_metadata",
    "validate_errors": "WITH c AS (SELECT *, (coalesce(trim(document_number), '') = '')::INT + (coalesce(trim(issue_date), '') = '')::INT + (coalesce(trim(ministry), '') = '')::INT + (coalesce(trim(subject), '') = '')::INT AS absent, "
    f"{_ISSUE} AS valid FROM decision_metadata), e AS (SELECT decision_id, list_filter([CASE WHEN filename IS NULL THEN 'missing filename' END, CASE WHEN absent >= 4 THEN 'missing metadata' END, CASE WHEN valid = false THEN 'invalid issue_date' END, CASE WHEN document_type IS NULL THEN 'missing document_type' END, CASE WHEN signature IS NULL THEN 'missing signature' END], lambda v: v IS NOT NULL) AS errors FROM c) "
    f"SELECT decision_id, {_str('errors')} AS errors, len(errors) AS n_errors FROM e",
    "paragraph_coverage": "WITH r AS (SELECT document_id, arg_max(long_text, record_id) FILTER (WHERE true) AS any_text, max(record_id) AS record_id FROM loaded_legal_json WHERE document_id IS NOT NULL GROUP BY document_id), q AS (SELECT r.document_id, l.long_text FROM r JOIN loaded_legal_json l USING (record_id)), "
    "c AS (SELECT row_id, document_id, list_filter(string_split_regex(text, '\\r?\\n'), lambda v: trim(v) <> '') AS lines FROM chunks WHERE text IS NOT NULL) "
    "SELECT c.row_id, len(c.lines) AS n_lines, coalesce(len(list_filter(c.lines, lambda v: contains(q.long_text, v))), 0) AS n_covered FROM c LEFT JOIN q ON c.document_id = q.document_id",
}
