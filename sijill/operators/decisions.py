"""Facts of a decision read from its lines and text (survey 2.7, 2.11), for both engines.

`ps` is a column of non-blank lines, `x` one of the whole text, `f` the text with letters
folded. Where a fact isn't stated, null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.functions.dialect import Dialect
from sijill.functions.extract import DATE

_D = "[0-9٠-٩]"
_NUMBER = rf"\(?\s*{_D}+(?:[.,]{_D}+)*\s*\)?\s*"
# How facts are introduced.
MINISTRY_LINE = r"^(وزارة\s+[^/،\n]+)(?:\s*/\s*(.+))?$"
DOCUMENT_NUMBER = r"رقم\s*\(([^)]*)\)"
REFERENCE_NUMBER = r"(?:المرقم(?:ة)?\s+بالعدد|العدد)\s*\(([^)]*)\)"
SUBJECT = r"الموض[ـ\s]*وع\s*[/:\-]\s*(.+)"
SESSION = r"(?:الجلسة|جلسته)\s+(.{1,80}?)\s+المنعقدة\s+(?:في\s+)?(" + DATE + ")"
YEAR_OF = r"سن[ـ\s]*ة\s*([0-9٠-٩]{4})"
SIGNER = "الامين|الوزير|المدير"
DISTRIBUTION = r"ص[ـ\s]*ورة\s+عن[ـ\s]*ه\s+ا?ل[ـ\s]*ي"
ATTACHMENTS = r"الم[ـ\s]*رافق[ـ\s]*ات"
PAGE_MARK = r"^\(?[0-9٠-٩]+\s*-\s*[0-9٠-٩]+\)?$"
# Measures and other values in text.
FIELDS = {
    "money": rf"\(?\s*{_D}+(?:[.,]{_D}+)*\s*\)?\s*(?:دينار|دولار|سنت|USD|\$)",
    "percentages": rf"\(?\s*{_D}+(?:[.,]{_D}+)?\s*%\s*\)?",
    "durations": _NUMBER + "(?:يوم|يوما|يومًا|يوماً|شهر|شهرا|شهرًا|شهراً|سنة|سنوات)",
    "pipe_lengths": r"(?:بطول|طول(?:ها|ه)?)\s*" + _NUMBER + "(?:كم|متر|م)",
    "diameters": r"(?:بقطر|قطر(?:ها|ه)?)\s*" + _NUMBER + "(?:ملم|سم|متر|انج|إنج)",
    "thickness": r"(?:بسمك|سمك(?:ها|ه)?)\s*" + _NUMBER + "(?:ملم|سم|متر|انج|إنج)",
    "quantities": r"(?:بعدد|عدد|كمية)\s*" + _NUMBER + r"(?:[\x{0621}-\x{064a}A-Za-z]{2,30})?",
}
LEGAL_REFERENCE = r"(?:قانون|قرار|نظام|تعليمات|امر|أمر)\s+(?:مجلس\s+الوزراء\s+)?(?:[\x{0621}-\x{064a}\s]{0,80}?)?(?:رقم\s*)?\(?\s*[0-9٠-٩]+(?:\s+لسنة\s+[0-9٠-٩]+)?\s*\)?"
NAMED = r"(?:وزارة|الأمانة\s+العامة|الامانة\s+العامة|مجلس|هيئة|شركة|ديوان)\s+[^/،.\n]{2,80}"
RESPONSIBLE = ["تتحمل", "تلتزم", "لاخذ ما يقتضي", "للتاشير والمتابعة"]
OUTCOME = ["الموافقة", "استثناء", "اقرار", "قرر"]
# The second reader's own forms.
DECISION_NUMBER = r"رق\s*ـ*\s*م\s*\(([^)]*)\)"
BOOK = r"(?:كتابها|كتابنا|المذكرة|مذكرتكم|رسالته|العدد)\s*(?:المرقم(?:ة)?\s+بالعدد)?\s*\(([^)]{2,120})\)"
RECOMMENDATION = r"(?:توصية|توصيات).{0,120}?\(([^)]*[0-9٠-٩][^)]*)\)"
SIGNER_WIDE = "الامي|الوزير|المدير|الرئيس"


def fold(q: Dialect, x: str) -> str:
    """Marks and stretching dropped, alef and yeh in one form."""
    return q.fold(q.sub(x, r"[\x{064b}-\x{065f}\x{0670}\x{0640}]", ""), ("أإآى", "اااي"))


def clean(q: Dialect, x: str, ends: str = r" \t:\-/،.()") -> str:
    """Blanks squeezed, marks at both ends dropped; null for nothing."""
    return f"nullif({q.sub(q.sub(x, r'\s+', ' '), f'^[{ends}]+|[{ends}]+$', '')}, '')"


def clean_number(q: Dialect, x: str) -> str:
    """As clean, and null without any letter or digit."""
    value = clean(q, x)
    return f"CASE WHEN {q.match(value, r'[0-9٠-٩A-Za-z\x{0621}-\x{064a}]')} THEN {value} END"


def first_of(q: Dialect, xs: str, v: str, body: str) -> str:
    """The first value that isn't null or empty, over the elements of a list."""
    return q.at(q.keep(q.each(xs, v, body), "w", "w IS NOT NULL AND w <> ''"), 1)


def where_first(q: Dialect, ps: str, condition) -> str:
    """The place of the first line that meets a condition, null without one."""
    return q.at(q.places(ps, "i", condition(q.at(ps, "i"))), 1)


def is_signer(q: Dialect, p: str) -> str:
    folded = fold(q, p)
    return f"(length({folded}) <= 90 AND NOT {q.has(folded, '/')} AND {q.match(folded, SIGNER)})"


def is_stamp(q: Dialect, p: str) -> str:
    """A short line with a date, as the foot of a page bears it."""
    folded = fold(q, p)
    return f"({q.match(folded, DATE)} AND length({folded}) < 80 AND length({folded}) - length(replace({folded}, '/', '')) <= 2)"


def stages(q: Dialect, key: str, name: str, source: str) -> str:
    """A subquery with key, name, x, f, ps and the places of signature, attachments and distribution."""
    base = f"SELECT {key} AS k, {q.text(name)} AS name, {q.text('long_text')} AS x, {fold(q, q.text('long_text'))} AS f, {q.lines('long_text')} AS ps FROM {q.table(source)}"
    sign = where_first(q, "ps", lambda p: is_signer(q, p))
    at = lambda pattern: where_first(q, "ps", lambda p: q.match(fold(q, p), pattern))
    return f"SELECT *, {sign} AS sign, {at(ATTACHMENTS)} AS att, {at(DISTRIBUTION)} AS dist FROM ({base})"


def issue_date(q: Dialect) -> str:
    """The date in the three lines after the signature, else the last date of the text."""
    after = q.slice("ps", "sign + 1", 3)
    signed = f"CASE WHEN sign IS NOT NULL THEN {first_of(q, after, 'p', q.find('p', DATE))} END"
    dates = q.all(q.join("ps", "chr(10)"), DATE)
    return clean(q, f"coalesce({signed}, {q.at(dates, f'greatest({q.size(dates)}, 1)')})")


def attachments(q: Dialect) -> str:
    """Lines from the attachments' heading to the signature, the distribution or a page mark."""
    place = q.at(q.places("ps", "i", f"i > att AND {_stop(q, q.at('ps', 'i'))}"), 1)
    early = q.at(q.places("ps", "i", f"i > att AND {is_signer(q, f'coalesce({q.at('ps', 'i + 1')}, {q.s('')})')}"), 1)
    end = f"least(coalesce({place}, {q.size('ps')} + 1), coalesce({early}, {q.size('ps')} + 1))"
    own = q.slice("ps", "att + 1", f"greatest({end} - att - 1, 0)")
    return f"CASE WHEN att IS NOT NULL THEN {q.join(q.keep(q.each(own, 'p', clean(q, 'p')), 'w', 'w IS NOT NULL'), ' | ')} ELSE '' END"


def _stop(q: Dialect, p: str) -> str:
    return f"({is_signer(q, p)} OR {q.match(fold(q, p), DISTRIBUTION)} OR {q.match(p, PAGE_MARK)})"


def distribution(q: Dialect) -> str:
    """Lines after the distribution's heading, without page marks and stamps."""
    own = q.slice("ps", "dist + 1", f"greatest({q.size('ps')} - dist, 0)")
    kept = q.keep(own, "p", f"NOT ({q.match('p', PAGE_MARK)} OR {is_stamp(q, 'p')})")
    return f"CASE WHEN dist IS NOT NULL THEN {q.join(q.keep(q.each(kept, 'p', clean(q, 'p')), 'w', 'w IS NOT NULL'), ' | ')} ELSE '' END"


def metadata(q: Dialect) -> str:
    """Number, year, dates, session, parties, subject, signature, attachments and distribution of every record."""
    first, head5, head8, head10 = q.at("ps", 1), q.slice("ps", 1, 5), q.slice("ps", 1, 8), q.slice("ps", 1, 10)
    ministry = clean(q, q.find(q.text(first), MINISTRY_LINE, 1))
    department = clean(q, q.find(q.text(first), MINISTRY_LINE, 2))
    council = f"CASE WHEN {q.some(head5, 'p', q.has('p', 'مجلس الوزراء'))} THEN 'مجلس الوزراء' END"
    to = f"CASE WHEN {q.match('p', '^(?:إلى|الى)')} THEN {clean(q, q.sub('p', '^[^/]*/', ''))} END"
    name = f"CASE WHEN sign > 1 THEN {clean(q, q.at('ps', 'sign - 1'))} END"
    title = f"CASE WHEN sign > 1 THEN {clean(q, q.at('ps', 'sign'))} END"
    number = f"CASE WHEN {q.any('p', ['رق', 'عدد'])} THEN {clean_number(q, q.find('p', DOCUMENT_NUMBER, 1))} END"
    fields = {
        "document_number": first_of(q, head8, "p", number),
        "document_year": f"coalesce({first_of(q, head10, 'p', q.find(fold(q, 'p'), YEAR_OF, 1))}, nullif({q.find(issue_date(q), '[0-9٠-٩]{4}')}, ''))",
        "issue_date": issue_date(q),
        "ministry": ministry,
        "department": department,
        "subject": clean(q, q.find("x", SUBJECT, 1)),
        "session_number": clean(q, q.find("f", SESSION, 1)),
        "session_date": clean(q, q.find("f", SESSION, 2)),
        "reference_number": clean_number(q, q.find("x", REFERENCE_NUMBER, 1)),
        "sender": f"coalesce({ministry} || coalesce(' / ' || {department}, ''), {council})",
        "recipient": first_of(q, head8, "p", to),
        "signature": f"coalesce({name} || ' - ' || {title}, {name}, {title})",
        "attachments": attachments(q),
        "distribution": distribution(q),
    }
    return f"SELECT k AS record_id, {', '.join(f'{v} AS {c}' for c, v in fields.items())} FROM ({stages(q, 'record_id', 'source_file', 'loaded_legal_json')})"


def second_metadata(q: Dialect) -> str:
    """What the reader of Word decisions takes: title, type, number, year, session, parties, signature and typed references."""
    head5, head6, head8, head10 = (q.slice("ps", 1, n) for n in (5, 6, 8, 10))
    stem = q.sub("name", r"\.[^.]*$", "")
    head = fold(q, f"coalesce(nullif({q.join(head5, 'chr(10)')}, ''), x)")
    signer = where_first(q, "ps", lambda p: f"(length({fold(q, p)}) <= 90 AND {q.match(fold(q, p), SIGNER_WIDE)})")
    rows = f"SELECT *, {signer} AS wide FROM ({stages(q, 'record_id', 'source_file', 'loaded_legal_json')})"
    signed = f"CASE WHEN wide IS NOT NULL THEN {clean(q, first_of(q, q.slice('ps', 'wide + 1', 3), 'p', q.find('p', DATE)))} END"
    dates = q.all("x", DATE)
    year = f"coalesce({first_of(q, head10, 'p', q.find(fold(q, 'p'), 'لسن[ـ ]*ة *([0-9٠-٩]{4})', 1))}, right({signed}, 4), nullif({q.find('x', '[0-9٠-٩]{4}')}, ''))"
    sender = f"CASE WHEN {q.match('p', '^وزارة')} OR {q.has('p', 'مجلس الوزراء')} THEN {clean(q, 'p')} END"
    typed = lambda pattern: q.unique(q.keep(q.each(q.all("f", pattern, 1), "v", clean(q, "v")), "v", "v IS NOT NULL"))
    fields = {
        "title": f"CASE WHEN {q.size('ps')} >= 2 AND {q.has(fold(q, q.text(q.at('ps', 1))), 'قرار')} THEN {q.join(q.slice('ps', 1, 2), ' ')} ELSE coalesce({q.at('ps', 1)}, {stem}) END",
        "document_type": f"CASE WHEN {q.has(head, 'قرار')} AND {q.has(head, 'مجلس الوزراء')} THEN 'قرار مجلس الوزراء' WHEN {q.has(head, 'الموضوع')} AND {q.has('f', 'قرار مجلس الوزراء')} THEN 'كتاب إرفاق قرار مجلس الوزراء' WHEN {q.has(head, 'قانون')} THEN 'قانون' END",
        "decision_number": clean(q, f"coalesce({first_of(q, head8, 'p', q.find(fold(q, 'p'), DECISION_NUMBER, 1))}, '')"),
        "year": year,
        "issue_date": f"coalesce({signed}, {clean(q, q.at(dates, f'greatest({q.size(dates)}, 1)'))})",
        "sender": first_of(q, head6, "p", sender),
        "recipient": first_of(q, head8, "p", f"CASE WHEN {q.match('p', '^(?:إلى|الى)')} THEN {clean(q, 'p')} END"),
        "signer_name": f"CASE WHEN wide > 1 THEN {clean(q, q.at('ps', 'wide - 1'))} END",
        "signer_title": f"CASE WHEN wide IS NOT NULL THEN {clean(q, q.at('ps', 'wide'))} END",
        "recommendation_references": q.join(typed(RECOMMENDATION), " | "),
        "reference_references": q.join(typed(BOOK), " | "),
        "n_characters": "CAST(length(x) AS BIGINT)",
        "n_paragraphs": q.size("ps"),
    }
    return f"SELECT k AS record_id, {', '.join(f'{v} AS {c}' for c, v in fields.items())} FROM ({rows})"


def _values(q: Dialect, pattern: str, x: str = "x") -> str:
    return q.keep(q.each(q.all(x, pattern), "v", clean(q, "v", r" \t:\-/،.")), "v", "v IS NOT NULL")


def field_values(q: Dialect) -> str:
    """Measures, sums, shares and years of every record, each once however its letters are written."""
    lists = ", ".join(f"{_values(q, p)} AS {k}" for k, p in FIELDS.items())
    # a year may follow another after one blank, which an engine without look-around would use up
    years = q.all(q.sub("x", "[^/0-9٠-٩]", "  "), r"(?:^|[^/0-9٠-٩])([0-9٠-٩]{4})(?:$|[^/0-9٠-٩])", 1)
    rows = f"SELECT record_id, {lists}, {years} AS years FROM (SELECT record_id, {q.text('long_text')} AS x FROM {q.table('loaded_legal_json')})"
    return f"SELECT record_id, {', '.join(q.join(q.distinct_by(k, 'v', fold(q, 'v')), ' | ') + f' AS {k}' for k in [*FIELDS, 'years'])} FROM ({rows})"


def content(q: Dialect) -> str:
    """References, responsibilities, outcome and affected parties of every record, by its lines."""
    rows = f"SELECT k, x, ps, {_values(q, LEGAL_REFERENCE)} AS refs, {q.keep('ps', 'p', q.any(fold(q, 'p'), RESPONSIBLE))} AS duties, {q.keep(q.each(q.all('x', NAMED), 'v', clean(q, 'v')), 'v', 'v IS NOT NULL')} AS named FROM ({stages(q, 'record_id', 'source_file', 'loaded_legal_json')})"
    about = q.match(fold(q, "p"), "^الموضوع")
    decided = q.keep("ps", "p", f"NOT {about} AND {q.has(fold(q, 'p'), 'قرر')}")
    other = q.keep("ps", "p", f"NOT {about} AND {q.any(fold(q, 'p'), OUTCOME)}")
    ordered = f"list_sort({q.unique('refs')})" if q.duck else f"array_sort({q.unique('refs')})"
    return f"SELECT k AS record_id, {q.join(ordered, ' | ')} AS legal_references, {q.join(q.distinct_by('duties', 'v', fold(q, 'v')), ' | ')} AS responsibilities, coalesce({q.at(decided, 1)}, {q.at(other, 1)}) AS outcome, {q.join(q.distinct_by('named', 'v', fold(q, 'v')), ' | ')} AS affected FROM ({rows})"


def with_number(spans: DataFrame) -> DataFrame:
    """Spans under one number, made of their record and first line."""
    return spans.withColumn("span", F.shiftleft("record_id", 24) + F.col("first"))


def legal_spans(q: Dialect) -> str:
    """Every record's lines as the legal chunker takes them: an item with what follows it up to the next item or the signature; all other lines alone."""
    from sijill.operators.structure import ITEM

    lines = f"SELECT k, sign, {q.rows(q.places('ps', 'i', 'true'))} AS i, ps FROM ({stages(q, 'record_id', 'source_file', 'loaded_legal_json')})"
    marked = f"SELECT k, i, coalesce(sign, {q.size('ps')} + 1) AS sign, {q.at('ps', 'i')} AS line, CASE WHEN {q.match(q.at('ps', 'i'), ITEM)} THEN i END AS item FROM ({lines})"
    spans = f"SELECT k, i, line, CASE WHEN i >= sign THEN NULL ELSE max(item) OVER (PARTITION BY k ORDER BY i) END AS item FROM ({marked})"
    label = "CASE WHEN item IS NULL THEN 'paragraph' ELSE 'item' END"
    start = "coalesce(item, i)"
    # a span's lines are some of one record's: they are put together in their order
    text = "string_agg(line, chr(10) ORDER BY i)" if q.duck else "array_join(transform(array_sort(collect_list(struct(i, line))), x -> x.line), chr(10))"
    return f"SELECT k AS record_id, {label} AS label, CAST({start} AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, {text} AS text FROM ({spans}) GROUP BY k, {label}, {start}"
