"""Law records made of plain text: the converter's and the government profile's fields (survey 2.3, 2.11), for both engines."""

from __future__ import annotations

from sijill.functions import arabic as A
from sijill.functions.dialect import Dialect
from sijill.operators.decisions import first_of
from sijill.operators.questions import B, E

_D = "0-9٠-٩۰-۹"
# Authorities in order of precedence, and the subtype each gives.
AUTHORITIES = {
    "سلطة الائتلاف المؤقتة": "CPA", "مجلس الحكم": "Council", "مجلس الوزراء": "Cabinet", "مجلس النواب": "Parliament",
    "وزارة": "Ministry", "محكمة": "Court", "رئاسة": "Presidency", "المفوضية": "Independent Commission",
}
# Types by the word that tells them, in order; the prefix of their ids.
TYPES = {"دستور": "constitution", "تعديل": "amendment", "أمر": "order", "قرار": "decision", "تعليمات": "instruction", "تنظيم": "regulation", "قانون": "law"}
# Subjects and their words.
CATEGORIES = [
    (["دستور", "دستوري"], ["دستوري"]),
    (["إرهاب", "جريمة", "عقوبة", "جنائي", "قضائي"], ["أمن", "جنائي"]),
    (["استثمار", "اقتصاد", "مستثمر", "ضريبة", "مصرف"], ["استثمار", "مالية"]),
    (["أمن", "عسكري", "قوات", "جيش"], ["أمن"]),
    (["تعليم", "صحة", "شهادة", "رعاية", "حقوق"], ["إداري"]),
    (["انتخاب", "انتخابات", "برلماني"], ["انتخابات"]),
]
STOPS = [
    "و", "في", "من", "على", "إلى", "عن", "ال", "هذا", "هذه", "ذلك", "أن", "ل", "لها", "له", "ب", "ت", "ثم", "ما", "لم", "لن", "لا", "كان", "بأنه",
    "أي", "كل", "كما", "منذ", "بعد", "قبل", "أو", "وقد", "يتم", "تم", "لأن", "فإن", "قد", "بين", "أجل", "أحد", "بشكل",
]
FILLERS = ["قانون", "عراق", "تشريعي", "حقوق", "تنظيم"]
LEADS = r"^(?:العنوان|الشرح التفصيلي|الأسباب الموجبة|الهيكل التنظيمي|أبرز المواد والفقرات التفصيلية|المادة)\s*[:：]\s*"
# The government profile's patterns.
NUMBERED = {"law": ("قانون", 4), "decision": ("قرار", 5), "regulation": ("نظام", 4), "instruction": ("تعليمات", 4), "order": ("(?:امر|أمر)", 4), "decree": ("مرسوم", 4), "amendment": ("(?:تعديل|قانون التعديل)", 5)}
PROFILE_YEAR = rf"(?:لسنة|سنة|لعام|عام)\s*([12][0-9]{{3}}|[٠-٩۰-۹]{{4}})"
PROFILE_DATE = rf"[{_D}]{{1,2}}\s*[/-]\s*[{_D}]{{1,2}}\s*[/-]\s*[{_D}]{{4}}"
GAZETTE = rf"(?:جريدة الوقائع العراقية|الوقائع العراقية)(?:\s+بالعدد)?\s*([{_D}]+)?"
TITLE_WORDS = ["قانون", "قرار", "نظام", "تعليمات", "أمر", "امر", "مرسوم", "تعديل"]
CLAUSE = rf"^(?:[{_D}]+[.)-]|[أ-ي]+[.)-]|اولاً|أولاً|ثانياً|ثالثاً|رابعاً)"
ARTICLE = rf"(^|\n)\s*((?:المادة|مادة)\s*(?:\(|\s)?(?:[{_D}]+|[اأإآء-ي]+))"
_MARK = "\u001d"


def ascii_digits(q: Dialect, x: str) -> str:
    return q.fold(x, A.DIGITS)


def authority(q: Dialect, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {q.has(x, w)} THEN '{w}'" for w in AUTHORITIES) + " ELSE '' END"


def subtype(q: Dialect, of: str) -> str:
    return "CASE " + " ".join(f"WHEN {of} = '{w}' THEN '{k}'" for w, k in AUTHORITIES.items()) + " ELSE '' END"


def document_type(q: Dialect, x: str) -> str:
    """The first of the types whose word stands alone in the text; a law without any."""
    return "CASE " + " ".join(f"WHEN {q.match(x, B + w + E)} THEN '{k}'" for w, k in TYPES.items()) + " ELSE 'law' END"


def number(q: Dialect, x: str) -> str:
    """The number named as one, else the first lone number of at most four digits that isn't 0."""
    named = ascii_digits(q, q.find(x, r"(?:رقم|number)\s*(?:\(|\s)?([٠-٩0-9]{1,9})", 1))
    lone = q.keep(q.each(q.all(q.sub(x, r"([^\p{L}\p{N}_])", r"\1\1"), B + "([٠-٩0-9]{1,4})" + E, 1), "n", ascii_digits(q, "n")), "n", f"{q.match('n', '[1-9]')}")
    return f"CAST(coalesce(nullif({named}, ''), {q.at(lone, 1)}) AS BIGINT)"


def year(q: Dialect, x: str) -> str:
    return f"CAST(nullif({ascii_digits(q, q.find(x, r'(?:لسنة|سنة|\()([٠-٩0-9]{4})(?:\)|\s|$)', 1))}, '') AS BIGINT)"


def categories(q: Dialect, x: str) -> str:
    """Subjects by their words, each once; administrative without any."""
    flags = [f"CASE WHEN {q.any(x, words)} THEN '{c}' END" for words, names in CATEGORIES for c in names]
    own = q.unique(q.keep(q.list(*flags), "c", "c IS NOT NULL"))
    return f"CASE WHEN {q.size(own)} > 0 THEN {own} ELSE {q.words(['إداري'])} END"


def keywords(q: Dialect, x: str) -> str:
    """The first twelve different words of weight; general ones fill up where there are fewer than five."""
    words = q.unique(q.keep(q.each(q.all(x, r"[\x{0600}-\x{06FF}]+"), "w", q.sub("w", "^[ :؛،]+|[ :؛،]+$", "")), "w", f"length(w) > 1 AND NOT {q.inside(q.words(STOPS), 'w')}"))
    return q.slice(f"CASE WHEN {q.size(words)} < 5 THEN {q.concat(words, q.words(FILLERS))} ELSE {words} END", 1, 12)


def summary(q: Dialect, ps: str, title: str) -> str:
    """The first sentence of the lines after the first, at most 280 characters."""
    rest = f"CASE WHEN {q.size(ps)} > 1 THEN {q.slice(ps, 2, f'greatest({q.size(ps)} - 1, 0)')} ELSE {ps} END"
    flat = q.sub(q.sub(q.join(rest, " "), LEADS, ""), r"^[0-9]+\.?\s*", "")
    first = q.strip(q.find(flat, r"^\s*\S[\s\S]*?(?:[.؟!](?:\s|$)|$)"))
    return f"CASE WHEN {first} = '' THEN {title} WHEN length({first}) > 280 THEN {q.sub(q.cut(first, 277), r'\s+$', '')} || '...' ELSE {first} END"


def record_id(q: Dialect, kind: str, who: str, n: str, y: str) -> str:
    text = "VARCHAR(20)" if q.duck else "STRING"
    tail = f"coalesce(CAST(nullif({n}, 0) AS {text}), '0') || '-' || coalesce(CAST(nullif({y}, 0) AS {text}), '0000')"
    return (
        f"CASE WHEN {kind} = 'constitution' THEN 'CONST-' || coalesce(CAST(nullif({y}, 0) AS {text}), '0000') WHEN {kind} = 'law' THEN 'LAW-' || {tail} WHEN {kind} = 'order' AND {q.has(who, 'سلطة الائتلاف')} THEN 'CPA-' || {tail} "
        f"WHEN {kind} = 'decision' AND {who} IN ('مجلس الوزراء', 'مجلس الحكم') THEN 'CM-' || {tail} WHEN {kind} = 'amendment' THEN 'AMD-' || {tail} ELSE upper(substring({kind}, 1, 3)) || '-' || {tail} END"
    )


def citation(q: Dialect, kind: str, title: str, who: str, n: str, y: str) -> str:
    text = "VARCHAR(20)" if q.duck else "STRING"
    end = f"' رقم ' || CAST({n} AS {text}) || ' لسنة ' || CAST({y} AS {text})"
    by = lambda lead, other: f"'{lead} ' || coalesce(nullif({who}, ''), '{other}') || {end}"
    named = f"CASE {kind} WHEN 'law' THEN 'قانون' || {end} WHEN 'decision' THEN {by('قرار', 'مجلس الوزراء')} WHEN 'order' THEN {by('أمر', 'سلطة الائتلاف المؤقتة')} WHEN 'regulation' THEN 'تنظيم' || {end} WHEN 'instruction' THEN 'تعليمات' || {end} WHEN 'amendment' THEN 'تعديل قانون' || {end} END"
    return f"CASE WHEN {kind} = 'constitution' THEN 'دستور العراق' WHEN {n} <> 0 AND {y} <> 0 THEN coalesce({named}, {title}) ELSE {title} END"


def law_records(q: Dialect) -> str:
    """Every record's text as a law record: title, authority, type, number, year, subjects, keywords, summary, id and citation."""
    base = f"SELECT record_id AS k, {q.text('long_text')} AS x, {q.lines('long_text')} AS ps FROM {q.table('loaded_legal_json')}"
    headed = q.sub(q.sub(q.sub(q.text(q.at("ps", 1)), rf"^\s*[{_D}]+\.\s*", ""), r":[\s\S]*$", ""), r"^العنوان\s*[:：]\s*", "")
    named = q.at(q.keep(q.each(q.keep(q.slice("ps", 2, f"greatest({q.size('ps')} - 1, 0)"), "p", q.has("p", "العنوان")), "p", q.sub(q.strip(q.sub("p", "العنوان", "")), "^:+|:+$", "")), "p", f"{q.strip('p')} <> ''"), 1)
    rows = f"SELECT k, x, ps, coalesce({q.strip(named)}, {q.strip(headed)}) AS title, {authority(q, 'x')} AS who, {number(q, 'x')} AS n, {year(q, 'x')} AS y FROM ({base})"
    rows = f"SELECT *, {document_type(q, 'title || chr(32) || x')} AS kind, lower(title || ' ' || x) AS low FROM ({rows})"
    return (
        f"SELECT k AS record_id, title, kind AS document_type, {subtype(q, 'who')} AS document_subtype, n AS number, y AS year, who AS issuing_authority, {q.join(categories(q, 'low'), ' | ')} AS categories, {q.join(keywords(q, 'title || chr(32) || x'), ' ')} AS keywords, "
        f"{summary(q, 'ps', 'title')} AS summary, {record_id(q, 'kind', 'who', 'n', 'y')} AS id, {citation(q, 'kind', 'title', 'who', 'n', 'y')} AS citation FROM ({rows})"
    )


def articles(q: Dialect, x: str) -> str:
    """A text's articles, each from its heading line; empty without any."""
    parts = q.split(q.sub(x, ARTICLE, rf"\1{_MARK}\2"), _MARK)
    return q.slice(parts, 2, f"greatest({q.size(parts)} - 1, 0)")


def government_records(q: Dialect) -> str:
    """Every record by the government profile: title, type, number, year, authority, dates, gazette, status, id and counts of articles and clauses."""
    from sijill.functions.extract import GOVERNMENT_TYPES

    base = f"SELECT record_id AS k, {q.text('source_file')} AS name, {q.text('long_text')} AS x, {q.lines('long_text')} AS ps FROM {q.table('loaded_legal_json')}"
    hay = f"lower(name || chr(10) || {q.cut('x', 3000)})"
    kind = "CASE " + " ".join(f"WHEN {q.any('hay', words)} THEN '{k}'" for k, words in GOVERNMENT_TYPES) + " ELSE 'unknown' END"
    dates = q.unique(q.each(q.all("x", PROFILE_DATE), "d", ascii_digits(q, q.strip("d"))))
    rows = f"SELECT *, {kind} AS kind FROM (SELECT *, {hay} AS hay, {dates} AS ds FROM ({base}))"
    generic = q.find("x", rf"رقم\s*\(?([{_D}]+)\)?", 1)
    typed = "CASE kind " + " ".join(f"WHEN '{k}' THEN {q.find('x', rf'{word}(?:\s+\S+){{0,{n}}}?\s+رقم\s*\(?([{_D}]+)\)?', 1)}" for k, (word, n) in NUMBERED.items()) + " ELSE '' END"
    found = f"nullif({ascii_digits(q, f'coalesce(nullif({typed}, {q.s('')}), {generic})')}, '')"
    own_year = f"nullif({ascii_digits(q, q.find('x', PROFILE_YEAR, 1))}, '')"
    title = f"coalesce({first_of(q, 'ps', 'p', f'CASE WHEN length(p) <= 250 AND {q.any('p', TITLE_WORDS)} THEN p END')}, nullif({q.sub('name', r'\.[^.]*$', '')}, ''), 'Untitled')"
    ministry = q.sub(q.find("x", r"وزارة\s+[\x{0600}-\x{06ff}\s]+"), r"\s+", " ")
    who = f"CASE WHEN {q.has('x', 'مجلس الوزراء')} THEN 'مجلس الوزراء' WHEN {q.match('x', 'رئاسة الجمهورية|رئيس الجمهورية')} THEN 'رئاسة الجمهورية' WHEN {q.has('x', 'مجلس النواب')} THEN 'مجلس النواب' WHEN {ministry} <> '' THEN {q.strip(ministry)} END"
    slug = f"coalesce(nullif({q.sub(q.sub('lower(name)', '[^a-z0-9]+', '_'), '^_+|_+$', '')}, ''), 'document')"
    fields = f"SELECT k, x, ps, kind, name, {title} AS title, {found} AS n, {own_year} AS y, {who} AS who, {q.at('ds', 1)} AS published, {q.at('ds', 2)} AS effective, {q.match('x', GAZETTE)} AS gazetted, nullif({ascii_digits(q, q.find('x', GAZETTE, 1))}, '') AS issue FROM ({rows})"
    ident = f"CASE WHEN n IS NOT NULL OR y IS NOT NULL THEN kind || '-' || coalesce(n, 'unknown') || '-' || coalesce(y, 'unknown') ELSE kind || '-' || {slug} END"
    return (
        f"SELECT k AS record_id, title, kind AS document_type, n AS document_number, y AS year, who AS issuing_authority, published, effective, CASE WHEN gazetted THEN 'الوقائع العراقية' END AS gazette_name, issue AS gazette_issue, "
        f"CASE WHEN {q.has('x', 'نافذ')} OR kind <> 'unknown' THEN 'active' ELSE 'unknown' END AS status, {ident} AS id, {q.size(articles(q, 'x'))} AS n_articles, {q.size(q.keep('ps', 'p', q.match('p', CLAUSE)))} AS n_clauses FROM ({fields})"
    )
