"""Texts of answers and of the sources they rest on: taking apart, checking, laying out (survey 2.4, 2.8, 2.9, 2.10, 2.13), for both engines."""

from __future__ import annotations

from sijill.functions.dialect import Dialect
from sijill.operators import questions as Q
from sijill.operators.decisions import where_first

# Citations, headings, titles and phrases of answers.
CITATION = r"\[المصدر:\s*(.+?)،\s*الصفحة:\s*([0-9٠-٩]+)\]"
SOURCE_HEADINGS = "Analysis / Relevant Legal Sources|Relevant Legal Sources|Legal Sources|المصدر|المصادر|Sources|Source"
ANSWER_HEADINGS = "الجواب|Answer"
TITLE_ONLY = r"^\s*(?:[-•]\s*)?(?:قانون|قرار|تعليمات|نظام)\s+.+?(?:رقم\s*\(?[0-9٠-٩]+\)?\s+لسنة\s*\(?[0-9٠-٩]+\)?|لسنة\s*\(?[0-9٠-٩]+\)?)\s*[.،؛:]*\s*$"
PENALTIES = ["عقوب", "غرام", "سجن", "حبس", "إعدام"]
ROUTING = ["صورة عنه الى", "صورة عنه إلى", "للاطلاع مع التقدير", "ربطا قراري مجلس الوزراء للاطلاع", "المرافقات قرار مجلس الوزراء"]
SUBSTANCE = ["قرر مجلس الوزراء", "قررر مجلس الوزراء", "بناء على ما عرضته", "اولا الموافقة", "أولا الموافقة", "ثانيا تتحمل", "ثانيًا تتحمل"]
DETAILS = ["قرر", "قرار", "اولا", "أولا", "ثانيا", "ثانيًا", "المادة"]
GENERIC = ["قرار", "قــرار", "دائرة شؤون مجلس ال", "دائرة شؤون مجلس الوزراء واللجان"]
INSUFFICIENT = ["لم أجد نصًا قانونيًا كافيًا للإجابة عن هذا السؤال في المستندات المتاحة.", "لا تحتوي المصادر القانونية المسترجعة", "لم تحتوي المصادر القانونية المسترجعة", "لم يحتوي المصادر القانونية المسترجعة"]
FIRST_CLAUSE, STOPS = "^(?:أولًا|أولاً)", r"^(?:صـور|صورة عنه|د\.|الأمين العام|مكتب رئيس|31/12/|18/12/)"
SECRETARIAT = r"(?:الأمانة|الامانة)\s+العامة\s+لمجلس\s+الوزراء"
SUMMARY_HEADING, TOPICS_HEADING = "الخلاصة:", "مواضيع مقترحة من نفس النص:"
STARTS = [r"بناء\s*[ًا]*\s+على", r"بنا\s*[ءاً]*\s+على", r"ق\s*ـ*\s*ر\s*ر\s+مجلس\s+الوزراء"]
FOOT = r"(?:الأمين|اأمين|األمين)\s+العام\s+لمجلس\s+الوزراء[\s\S]*$"
WEAK_TOKENS = ["ما", "من", "عن", "على", "في", "هل", "الى", "إلى", "اريد", "أريد"]
BOOK = r"(?s)كتاب\s+(.{0,80}?)\s+المرقم\s+بالعدد\s*\(\s*([^)]+?)\s*\)\s+المؤرخ\s+في\s+([0-9٠-٩/\\-]+)"
RECOMMENDATION = r"توصية\s+المجلس\s+الوزاري\s+للاقتصاد\s*\(\s*([^)]+?)\s*\)"
# What is said of a fact that is or isn't stated.
UNKNOWN_NUMBER, UNKNOWN_BOOK = "رقم القرار غير مثبت في النص المستخرج من الوثيقة.", "الكتاب الذي استند إليه تعديل الأسعار غير مثبت في النص المستخرج من الوثيقة."
UNKNOWN_RECOMMENDATION = "رقم توصية المجلس الوزاري للاقتصاد غير مثبت في النص المستخرج من الوثيقة."
DATE_LABELS = {"session_date": "تاريخ انعقاد الجلسة", "issue_date": "تاريخ صدور القرار"}
MISSING = "غير مثبت"


def body(q: Dialect, x: str) -> str:
    """An answer without citations and without the sections that list sources."""
    line = lambda words: rf"(?m)^[ \t#*_]*(?:{words})[ \t#*_]*:?[ \t#*_]*$"
    marked = q.sub(q.sub(q.sub(q.text(x), CITATION, ""), line(SOURCE_HEADINGS), "\u001d"), line(ANSWER_HEADINGS), "\u001e")
    return q.strip(q.sub(q.sub(marked, "\u001d[^\u001e]*", ""), "\u001e", ""))


def citations(q: Dialect, x: str) -> str:
    """`file|page` of each citation, once, in order."""
    files, pages = q.all(q.text(x), CITATION, 1), q.all(q.text(x), CITATION, 2)
    return q.unique(q.each(q.places(files, "i", "true"), "i", f"{q.strip(q.at(files, 'i'))} || '|' || {q.at(pages, 'i')}"))


def plain(q: Dialect, x: str) -> str:
    """The form in which answers and labels are compared."""
    return f"lower({q.strip(q.sub(q.text(x), r'[^\p{L}\p{N}_\x{0600}-\x{06ff}]+', ' '))})"


def title_only(q: Dialect, x: str) -> str:
    return f"(NOT contains({x}, chr(10)) AND {q.match(x, TITLE_ONLY)})"


def is_routing(q: Dialect, p: str) -> str:
    """A page that only forwards; p is in compared form."""
    return f"({q.any(p, ROUTING)} AND NOT {q.any(p, SUBSTANCE)})"


def is_decision(q: Dialect, p: str) -> str:
    return f"({q.has(p, 'مجلس')} AND {q.has(p, 'وزراء')} AND {q.any(p, DETAILS)})"


def is_generic(q: Dialect, p: str) -> str:
    return f"({p} = '' OR {p} IN ({', '.join(q.s(w) for w in GENERIC)}))"


def insufficient(q: Dialect, x: str) -> str:
    return q.any(x, INSUFFICIENT)


def unsupported_numbers(q: Dialect, answer: str, context: str) -> str:
    """Numbers of an answer that its context has neither so nor reversed."""
    from sijill.functions import arabic as A

    digits = lambda x: q.fold(q.text(x), A.DIGITS)
    there = q.all(digits(context), "[0-9]+")
    return q.unique(q.keep(q.all(digits(answer), "[0-9]+"), "n", f"NOT {q.inside(there, 'n')} AND NOT {q.inside(there, 'reverse(n)')}"))


def unsupported_penalties(q: Dialect, answer: str, context: str) -> str:
    return q.keep(q.list(*[f"CASE WHEN {q.has(q.text(answer), w)} AND NOT {q.has(q.text(context), w)} THEN '{w}' END" for w in PENALTIES]), "w", "w IS NOT NULL")


def detailed(q: Dialect, ls: str) -> str:
    """The lines from the first clause to the signature; ls is a column of stripped lines, blank ones too."""
    rest = f"CASE WHEN b IS NOT NULL THEN {q.slice(ls, 'b', f'{q.size(ls)} - b + 1')} ELSE {q.slice(ls, 1, 0)} END"
    stop = f"coalesce({q.at(q.places(ls, 'i', f'i > b AND {q.match(q.at(ls, 'i'), STOPS)}'), 1)}, {q.size(ls)} + 1)"
    own = f"CASE WHEN b IS NOT NULL THEN {q.slice(ls, 'b', f'{stop} - b')} ELSE {rest} END"
    return q.strip(q.sub(q.join(own, "chr(10)"), r"\n{3,}", "\n\n"))


def secretariat_once(q: Dialect, x: str) -> str:
    """The General Secretariat named at its first place only, marks and blanks tidied."""
    head = q.find(x, rf"^[\s\S]*?{SECRETARIAT}")
    out = f"{head} || {q.sub(f'substring({x}, length({head}) + 1)', SECRETARIAT, '')}"
    out = q.sub(q.sub(out, r"[ \t]{2,}", " "), r"\s+([،؛:.؟])", r"\1")
    return q.strip(q.sub(q.sub(out, r"([،؛])\s*([،؛:.؟])", r"\2"), r"\n[ \t]+", "\n"))


def first_sentence(q: Dialect, x: str) -> str:
    """A summary of an answer: its first sentence, at most 260 characters up to a word's end."""
    own = q.sub(q.sub(x, rf"{TOPICS_HEADING}[\s\S]*$", ""), rf"{SUMMARY_HEADING}[\s\S]*$", "")
    flat = q.join(q.each(q.lines(own), "v", q.strip(q.sub("v", r"^\s*[-•]\s*", ""))), " ")
    first = q.find(flat, r"^[\s\S]*?(?:[.؟!](?:\s|$)|$)")
    short = f"CASE WHEN length({q.strip(first)}) > 260 THEN {q.sub(q.cut(q.strip(first), 260), r'[ ][^ ]*$', '')} ELSE {q.strip(first)} END"
    return f"CASE WHEN {flat} = '' THEN '' ELSE {q.sub(short, '^[ .،؛]+|[ .،؛]+$', '')} || '.' END"


def readable(q: Dialect, x: str) -> str:
    """A decision's text from where it decides to its signature, laid out by clauses."""
    out = q.strip(q.sub(q.text(x), r"\s+", " "))
    begun = f"coalesce(nullif({q.find(out, '(?:' + '|'.join(STARTS) + r')[\s\S]*$')}, ''), {out})"
    out = q.strip(q.sub(begun, FOOT, ""))
    out = q.sub(q.sub(q.sub(out, r"\s*•\s*", "\n• "), r"\s+([:،؛.])", r"\1"), r"(\))\s+([،.])", r"\1\2")
    out = q.sub(out, r"\s+(أولاً|أولًا|ثانياً|ثانيًا|ثالثاً|ثالثًا)\s*[:：]", "\n• \\1:")
    return q.strip(q.sub(out, r"\s+([0-9٠-٩]+)\s*[.)-]\s+", "\n\\1. "))


def answerable(q: Dialect, x: str) -> str:
    """Different words of weight, as they stand."""
    weak = " OR ".join(f"t = '{w}'" for w in WEAK_TOKENS)
    return q.unique(q.keep(q.all(q.text(x), r"[\p{L}\p{N}_\x{0600}-\x{06ff}]+"), "t", f"length(t) > 2 AND NOT ({weak})"))


def match_score(q: Dialect, tokens: str, numbers: str, own: str, text: str) -> str:
    """Share of a question's tokens in a text, a quarter more for each of its numbers there, at most 1."""
    share = f"CAST({q.size(q.both(tokens, own))} AS DOUBLE) / {q.size(tokens)}"
    bonus = f"0.25 * {q.size(q.keep(numbers, 'n', f'contains({text}, n)'))}"
    return f"CASE WHEN {q.size(tokens)} = 0 THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), {share} + {bonus}) END"


def book_parts(q: Dialect, x: str) -> tuple[str, str, str]:
    """Issuer, number and date of the letter that a text rests on, empty where none is named."""
    tidy = lambda g: q.sub(q.sub(q.find(q.text(x), BOOK, g), r"\s+", " "), "^[ .،؛:]+|[ .،؛:]+$", "")
    return tidy(1), tidy(2), tidy(3)


def direct(q: Dialect, question: str, number: str, issue: str, session: str, text: str) -> str:
    """The answer to a question for a fact that metadata or the text states outright; null for another question."""
    issuer, book, dated = book_parts(q, text)
    asks = lambda patterns: Q.matches(q, question, patterns)
    field = Q.date_field(q, question)
    said = lambda name, value: f"CASE WHEN {q.text(value)} <> '' THEN '{DATE_LABELS[name]}: ' || {value} || '.' ELSE '{DATE_LABELS[name]} غير مثبت في النص المستخرج من الوثيقة.' END"
    advice = q.strip(q.sub(q.find(q.text(text), RECOMMENDATION, 1), r"\s+", " "))
    by = f"coalesce(nullif({issuer}, ''), 'الكتاب')"
    letter = (
        f"CASE WHEN {book} = '' THEN '{UNKNOWN_BOOK}' WHEN {q.match(question, 'رقم.{0,20}كتاب')} THEN 'رقم كتاب ' || {by} || ': ' || {book} || '.' WHEN {q.match(question, 'تاريخ.{0,20}كتاب')} THEN 'تاريخ كتاب ' || {by} || ': ' || {dated} || '.' "
        f"ELSE CASE WHEN {issuer} <> '' THEN 'كتاب ' || {issuer} ELSE 'الكتاب' END || ' المرقم بالعدد (' || {book} || ') المؤرخ في ' || {dated} || '.' END"
    )
    return (
        f"CASE WHEN {asks(Q.DECISION_NUMBER)} THEN CASE WHEN {q.text(number)} <> '' THEN 'رقم القرار هو ' || {number} || '.' ELSE '{UNKNOWN_NUMBER}' END WHEN {field} = 'session_date' THEN {said('session_date', session)} WHEN {field} = 'issue_date' THEN {said('issue_date', issue)} "
        f"WHEN {asks(Q.RECOMMENDATION_NUMBER)} THEN CASE WHEN {advice} <> '' THEN 'رقم توصية المجلس الوزاري للاقتصاد: ' || {advice} || '.' ELSE '{UNKNOWN_RECOMMENDATION}' END WHEN {asks(Q.SOURCE_BOOK)} THEN {letter} END"
    )


def confidence(q: Dialect, answer: str, score: str) -> str:
    """0 for no answer, else the best source's relevance between 0 and 1, 0.7 where that is unknown."""
    return f"CASE WHEN {q.text(answer)} = '' OR {insufficient(q, q.text(answer))} THEN CAST(0 AS DOUBLE) WHEN {score} IS NULL THEN CAST(0.7 AS DOUBLE) ELSE round(CAST(greatest(0, least(1, {score})) AS DOUBLE), 2) END"


def context_block(q: Dialect, n: str, fields: dict[str, str], listed: dict[str, str], retrieved: str, whole: str) -> str:
    """One document of an answer's context: labelled fields, lists, the passage and the whole text."""
    label = lambda k, v: f"'{k}:' || chr(10) || coalesce(nullif({q.strip(q.text(v))}, ''), '{MISSING}')"
    parts = [f"'DOCUMENT ' || CAST({n} AS VARCHAR(20))" if q.duck else f"'DOCUMENT ' || CAST({n} AS STRING)", *[label(k, v) for k, v in (fields | listed).items()], f"'RELEVANT RETRIEVED TEXT:' || chr(10) || {q.text(retrieved)}", f"'FULL SOURCE TEXT:' || chr(10) || coalesce(nullif({q.text(whole)}, ''), '{MISSING} في JSON الأصلي')"]
    return " || chr(10) || chr(10) || ".join(parts)


def _chunks(q: Dialect) -> str:
    records = f"SELECT document_id, max(long_text) AS t FROM {q.table('loaded_legal_json')} WHERE document_id IS NOT NULL GROUP BY document_id"
    return f"SELECT c.row_id, c.document_title, c.document_type, c.year, c.section_title, c.article_reference, c.page_number, {q.text('c.text')} AS x, {plain(q, 'c.text')} AS p, l.t FROM {q.table('chunks')} c LEFT JOIN ({records}) l ON c.document_id = l.document_id"


def answer_texts(q: Dialect) -> str:
    """Every chunk read as an answer: body, citations, kind, summary and layouts."""
    lines = q.each(q.split("x", r"\r?\n"), "v", q.strip("v"))
    rows = f"SELECT row_id, x, p, ls, {where_first(q, 'ls', lambda v: q.match(v, FIRST_CLAUSE))} AS b FROM (SELECT row_id, x, p, {lines} AS ls FROM ({_chunks(q)}))"
    return (
        f"SELECT row_id, md5({body(q, 'x')}) AS body, {q.join(citations(q, 'x'), ' ; ')} AS citations, {title_only(q, body(q, 'x'))} AS is_title, {is_routing(q, 'p')} AS is_routing, {is_decision(q, 'p')} AS is_decision, {q.any('p', SUBSTANCE)} AS is_substantive, {is_generic(q, 'p')} AS is_generic, "
        f"{insufficient(q, 'x')} AS is_insufficient, {first_sentence(q, 'x')} AS summary, md5({detailed(q, 'ls')}) AS detailed, md5({readable(q, 'x')}) AS readable, md5({secretariat_once(q, 'x')}) AS tidied FROM ({rows})"
    )


def answer_checks(q: Dialect) -> str:
    """Every chunk checked as an answer against its own record's text."""
    numbers, penalties = unsupported_numbers(q, "x", "t"), unsupported_penalties(q, "x", "t")
    return f"SELECT row_id, {q.join(numbers, ' ')} AS unsupported_numbers, {q.join(penalties, ' ')} AS unsupported_penalties, {confidence(q, 'x', 'CAST(NULL AS DOUBLE)')} AS confidence FROM ({_chunks(q)})"


def answer_contexts(q: Dialect) -> str:
    """The context block of every chunk."""
    fields = {"Title": "document_title", "Type": "document_type", "Year": "year", "Section": "coalesce(section_title, article_reference)"}
    return f"SELECT row_id, md5({context_block(q, 'coalesce(page_number, 1)', fields, {}, 'x', 't')}) AS context FROM ({_chunks(q)})"


def direct_facts(q: Dialect) -> str:
    """Each stock question put to every registration: what its metadata or record says outright."""
    question = "CASE topic " + " ".join(f"WHEN '{k}' THEN {q.s(v)}" for k, v in STOCK.items()) + " END"
    records = f"SELECT document_id, max(long_text) AS t FROM {q.table('loaded_legal_json')} WHERE document_id IS NOT NULL GROUP BY document_id"
    rows = f"SELECT s.search_id, s.decision_number, s.issue_date, s.session_date, l.t, {q.rows(q.words(STOCK))} AS topic FROM {q.table('search_records')} s LEFT JOIN ({records}) l ON s.document_id = l.document_id"
    asked = f"SELECT *, {question} AS question FROM ({rows})"
    return f"SELECT search_id, topic, {direct(q, 'question', 'decision_number', 'issue_date', 'session_date', 't')} AS answer FROM ({asked})"


#: Questions of each kind that metadata answers.
STOCK = {"number": "ما هو رقم القرار؟", "issue_date": "متى صدر هذا القرار؟", "session_date": "متى انعقدت هذه الجلسة؟", "recommendation": "ما رقم توصية المجلس الوزاري للاقتصاد؟", "book": "ما رقم كتاب الوزارة؟"}


def full_text_match(q: Dialect) -> str:
    """How well every record's whole text matches its registrations' titles."""
    records = f"SELECT document_id, max(long_text) AS t FROM {q.table('loaded_legal_json')} WHERE document_id IS NOT NULL AND long_text IS NOT NULL GROUP BY document_id"
    rows = f"SELECT s.search_id, {answerable(q, 's.title')} AS a, {q.all(q.text('s.title'), '[0-9٠-٩][0-9٠-٩/.,-]*')} AS n, {answerable(q, f'coalesce(s.filename, {q.s('')}) || chr(10) || l.t')} AS o, l.t FROM {q.table('search_records')} s JOIN ({records}) l ON s.document_id = l.document_id"
    return f"SELECT search_id, round({match_score(q, 'a', 'n', 'o', 't')}, 6) AS score FROM ({rows})"




def concise(q: Dialect, answer: str, sources: str) -> str:
    """An answer below its sources: two parts, and a note where there is no source."""
    listed = f"CASE WHEN {q.size(sources)} > 0 THEN {q.join(sources, 'chr(10)')} ELSE 'لا توجد مصادر مطابقة' END"
    return f"'Analysis / Relevant Legal Sources' || chr(10) || chr(10) || {listed} || chr(10) || chr(10) || 'Answer' || chr(10) || chr(10) || {body(q, answer)}"


def appended(q: Dialect, answer: str, topics: str) -> str:
    """An answer with its summary and topics, unless it has them or says nothing."""
    own = q.strip(q.sub(answer, rf"{TOPICS_HEADING}[\s\S]*$", ""))
    with_summary = f"CASE WHEN {q.has(own, SUMMARY_HEADING)} THEN {own} ELSE {own} || chr(10) || chr(10) || '{SUMMARY_HEADING}' || chr(10) || {first_sentence(q, answer)} END"
    listed = q.join(q.each(topics, "t", "'- ' || t"), "chr(10)")
    return f"CASE WHEN {q.strip(answer)} = '' OR {insufficient(q, answer)} THEN {answer} ELSE {with_summary} || chr(10) || chr(10) || '{TOPICS_HEADING}' || chr(10) || {listed} END"


def indexes(q: Dialect, x: str) -> str:
    """Whole numbers of a stored list of paragraphs, each once."""
    return q.unique(q.each(q.all(q.text(x), "[0-9]{1,9}"), "n", "CAST(n AS BIGINT)"))


def match_values(q: Dialect, names: list[str], titles: list[str]) -> str:
    """The labels by which a document may be named: files with and without their ending, titles as they are."""
    files = [q.strip(q.text(n)) for n in names]
    stems = [q.sub(q.sub(f, r"^.*/", ""), r"\.[^.]*$", "") for f in files]
    return q.unique(q.keep(q.list(*[v for pair in zip(files, stems) for v in pair], *[q.strip(q.text(t)) for t in titles]), "v", "v <> ''"))


def answer_layouts(q: Dialect) -> str:
    """Every chunk laid out as an answer: with its source, with summary and topics, and the labels of its document."""
    from sijill.operators.readers import topics

    rows = f"SELECT row_id, {q.text('text')} AS x, source_file, document_title, document_id FROM {q.table('chunks')}"
    sources = q.keep(q.list(q.strip(q.text("document_title"))), "v", "v <> ''")
    return f"SELECT row_id, md5({concise(q, 'x', sources)}) AS concise, md5({appended(q, 'x', topics(q, 'x'))}) AS appended, {q.join(match_values(q, ['source_file'], ['document_title', 'document_id']), ' | ')} AS labels FROM ({rows})"
