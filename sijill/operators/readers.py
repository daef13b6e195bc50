"""Further readers of text: the page-wise cleaner, typed references, entities and numbers, English profiles, topics (survey 2.6, 2.10 to 2.12), for both engines."""

from __future__ import annotations

from sijill.functions.dialect import Dialect
from sijill.functions.extract import DATE
from sijill.operators.decisions import BOOK, RECOMMENDATION, clean, first_of, fold
from sijill.operators.questions import B, E

_D = "[0-9٠-٩]"
# What a page leaves behind, and what makes a repeated line part of the text.
COUNTER = rf"^\(?\s*{_D}+\s*[-/]\s*{_D}+\s*\)?$"
WORD_COUNTER = rf"^(?:(?i:page)|صفحة|ص)\s*{_D}+\s*(?:(?i:of)|من|/|-)\s*{_D}+$"
STAMP = rf"^(?:[\x{{0621}}-\x{{064a}}A-Za-z]{{2,20}}\s+{DATE}\s*\(?\s*{_D}+\s*[-/]\s*{_D}+\s*\)?\s*)+$"
LEGAL_WORDS, MONEY_WORDS = ["قانون", "قرار", "نظام", "تعليمات", "مجلس الوزراء", "المادة"], ["دينار", "دولار", "$", "€", "£"]
NUMBERING = rf"^\s*(?:{_D}+[).-]|[أإا]ولا|ثانيا|ثالثا|رابعا|خامسا|[-*•])"
# Typed references, entities and numbers of the Word reader.
ARTICLE_REFERENCE = r"المادة\s*\([^)]{1,80}\)(?:\s*من\s*[^.\n]+)?"
CABINET_REFERENCE = r"قرار\s+مجلس\s+الوزراء\s*(?:رقم)?\s*\([^)]*\)?\s*لسنة\s*[0-9٠-٩]{4}"
DATED_REFERENCE = r"(?:المؤرخ(?:ة)?)\s+(?:في\s+)?(" + DATE + ")"
COMPANY = r"شركة\s*\([^)]{1,80}\)|شركة\s+[\x{0600}-\x{06ff}A-Za-z0-9\s]{2,80}"
ORGANISATION = r"(?:مكتب التعاون الأمني|وزارة|مجلس|شركة|المجلس|الأمانة|الامانة|الدائرة|مكتب|ديوان|محافظة|هيئة|الهيئة)[\x{0600}-\x{06ff}A-Za-z0-9 ()/\-]{1,70}?(?:\s+(?:بموجب|والتي|وتتحمل|صحة|سلامة|من|في|على)|[،.:\n]|$)"
ORGANISATION_END = r"(?:\s+(?:بموجب|والتي|وتتحمل|صحة|سلامة|من|في|على)|[،.:\n])$"
PERSON = r"(?:د\.\s*)[\x{0600}-\x{06ff}]{2,20}\s+[\x{0600}-\x{06ff}]{2,20}\s+[\x{0600}-\x{06ff}]{2,20}"
AMOUNT = r"\([0-9.,٠-٩]+\)\s*(?:دولار|دينار|%|كم|ملم|يوم|طائرة|عقدة)?"
NUMBER = r"\([0-9.,/\-٠-٩]+\)"
# The English profile's categories with their signals, and its labelled fields.
CATEGORIES = {
    "Cabinet Decision": ["cabinet", "decision", "ministerial council"], "Ministry Letter": ["ministry", "letter", "office"], "Recommendation": ["recommendation", "recommended", "proposal"],
    "Official Correspondence": ["official correspondence", "correspondence", "memorandum"], "Committee Formation": ["committee", "formation", "formed"], "Circular": ["circular", "notice", "announcement"],
    "Administrative Letter": ["administrative", "administration", "letter"],
}
LABELLED = {
    "document_number": r"(?is)doc(?:ument)?\s*no\.?\s*[:#-]?\s*([A-Za-z0-9/\-]+)", "decision_number": r"(?is)decision\s*(?:no\.?|number)\s*[:#-]?\s*([A-Za-z0-9/\-]+)", "decision_year": r"(?is)(?:decision\s*year\s*[:#-]?|for\s*the\s*year)\s*([0-9]{4})",
    "letter_number": r"(?is)letter\s*(?:no\.?|number)\s*[:#-]?\s*([A-Za-z0-9/\-]+)", "issue_date": r"(?is)(?:issue\s*date\s*[:#-]?|dated)\s*([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})", "session_number": r"(?is)session\s*no\.?\s*[:#-]?\s*([A-Za-z0-9/\-]+)",
    "ministry": r"(?is)ministry\s*[:#-]?\s*([A-Za-z\s]+?)(?:\n|$)", "subject": r"(?is)(?:subject|title)\s*[:#-]?\s*([A-Za-z0-9/\-\s]+?)(?:\n|$)",
}
SECTIONS = {
    "introductory_legal_basis": "(?i)legal basis|based on|pursuant to", "legal_references": "(?i)article|law|regulation|decision", "responsibilities": "(?i)responsible|shall|must",
    "implementation_clauses": "(?i)implementation|implemented|effective", "exceptions": "(?i)except|excluding|unless", "attachments": "(?i)attachment|annex", "requested_action": "(?i)request|requested|kindly",
}
HEADINGS = "^(?:باب|الباب|فصل|الفصل|مادة|المادة)"
# Suggested topics from a text's facts.
TOPIC_BOOK, TOPIC_CLAUSE, TOPIC_ENTITY = ("هل تريد معرفة أثر كتاب", " المرقم (", ") المؤرخ في ", "؟"), ("هل تريد أن أشرح لك البند ", " الوارد في النص؟"), ("أستطيع مساعدتك في توضيح دور ", " في النص.")
TOPIC_AMOUNT, TOPIC_DATE = ("أستطيع مساعدتك في توضيح تفاصيل المبلغ ", " الوارد في النص."), ("هل تريد معرفة دلالة تاريخ ", " في هذه الوثيقة؟")
SOURCE_ENTITY = r"(?:وزارة|شركة|مجلس|هيئة|دائرة|محافظة|لجنة)\s+[\x{0600}-\x{06FF} ]{2,55}"


def is_artifact(q: Dialect, v: str) -> str:
    """A line that only counts pages or stamps one."""
    return f"({q.match(v, COUNTER)} OR {q.match(v, WORD_COUNTER)} OR {q.match(fold(q, v), STAMP)})"


def may_repeat(q: Dialect, v: str) -> str:
    """Whether a line said twice in a row is a leftover of layout: short, no reference, sum or number of an item."""
    f = fold(q, v)
    return f"(NOT {q.any(f, LEGAL_WORDS)} AND NOT {q.any(f, MONEY_WORDS)} AND NOT {q.match(f, NUMBERING)} AND length({f}) <= 120)"


def page_cleaned(q: Dialect, x: str) -> str:
    """A text's lines, blanks tidied, without counters and stamps and without leftovers that repeat the line before."""
    lines = q.keep(q.lines(x), "v", f"NOT {is_artifact(q, 'v')}")
    tidy = q.each(lines, "v", q.sub("v", r"[ \t]{2,}", " "))
    same = f"{fold(q, q.at('ls', 'i'))} = {fold(q, q.at('ls', 'i - 1'))}"
    kept = q.each(q.places("ls", "i", f"i = 1 OR NOT ({same} AND {may_repeat(q, q.at('ls', 'i'))})"), "i", q.at("ls", "i"))
    return q.join(q.at(q.each(q.list(tidy), "ls", kept), 1), "chr(10)")


def _typed(q: Dialect, x: str, kinds: list[tuple[str, str, int]], ends: str = " ،.:-") -> str:
    """`type:text` of all matches, each once, in order of the kinds."""
    return q.unique(q.concat(*[q.keep(q.each(q.all(x, p, g), "v", f"'{name}:' || {clean(q, 'v', ends)}"), "v", "v IS NOT NULL") for name, p, g in kinds]))


def typed_references(q: Dialect, x: str) -> str:
    return _typed(q, x, [("legal_article", ARTICLE_REFERENCE, 0), ("cabinet_decision", CABINET_REFERENCE, 0), ("recommendation_number", RECOMMENDATION, 1), ("reference_number", BOOK, 1), ("date_reference", DATED_REFERENCE, 1)])


def typed_entities(q: Dialect, x: str) -> str:
    """Organisations, companies and titled persons; names under five characters are none."""
    organisations = q.keep(q.each(q.each(q.all(x, ORGANISATION), "v", q.sub("v", ORGANISATION_END, "")), "v", clean(q, "v", " ،.:-")), "v", "length(v) >= 5")
    rest = [("company", COMPANY), ("person", PERSON)]
    more = [q.each(q.keep(q.each(q.all(x, p), "v", clean(q, "v", " ،.:-")), "v", "length(v) >= 5"), "v", f"'{name}:' || v") for name, p in rest]
    return q.unique(q.concat(q.each(organisations, "v", "'organization:' || v"), *more))


def numeric_values(q: Dialect, x: str) -> str:
    """Bracketed values with what they measure; a value is told once, by its first kind."""
    kind = f"CASE WHEN {q.any('v', ['دولار', 'دينار'])} THEN 'money:' WHEN {q.has('v', '%')} THEN 'percentage:' ELSE 'quantity:' END"
    flat = lambda v: q.strip(q.sub(v, r"\s+", " "))
    amounts = q.unique(q.each(q.all(x, AMOUNT), "v", flat("v")))
    numbers = q.keep(q.unique(q.all(x, NUMBER)), "n", f"NOT {q.inside(amounts, 'n')}")
    return q.concat(q.each(amounts, "v", f"{kind} || v"), q.each(numbers, "n", "'number:' || n"))


def english_category(q: Dialect, low: str) -> tuple[str, str]:
    """The category with most signals, the earlier of equals, and its confidence; null and 0 without any."""
    scores = {k: "(" + " + ".join(f"CASE WHEN {q.match(low, B + w + E)} THEN 1.0 ELSE 0.0 END" for w in words) + f" + CASE WHEN {q.has(low, k.lower())} THEN 0.25 ELSE 0.0 END)" for k, words in CATEGORIES.items()}
    best = f"greatest({', '.join(scores.values())})"
    name = "CASE WHEN " + best + " = 0 THEN NULL " + " ".join(f"WHEN {s} = {best} THEN '{k}'" for k, s in scores.items()) + " END"
    return name, f"CAST(round(least(1.0, {best} / 3), 4) AS DOUBLE)"


def section_lines(q: Dialect, ps: str, pattern: str) -> str:
    """The first eight lines that speak of a section."""
    return q.join(q.slice(q.keep(ps, "p", q.match("p", pattern)), 1, 8), "chr(10)")


def topics(q: Dialect, x: str) -> str:
    """Up to three topics from a source's facts: its letter, a sum, a date, a clause, the first two parties."""
    from sijill.operators.answers import BOOK as LETTER
    from sijill.operators.law import TOPICS

    tidy = lambda v: q.sub(q.cut(q.sub(q.sub(v, r"\s+", " "), "^[ .،؛:]+|[ .،؛:]+$", ""), 70), "[ .،؛:]+$", "")
    part = lambda g: tidy(q.find(x, LETTER, g))
    amount, date = r"\(?\s*([0-9٠-٩][0-9٠-٩.,/ ]+)\s*\)?\s*(دينار|دولار)", q.find(x, B + f"({DATE})" + E, 1)
    clause = q.find(x, r"(أولاً|أولًا|ثانياً|ثانيًا|ثالثاً|ثالثًا)\s*[:：]?\s*.{10,90}", 1)
    parties = q.slice(q.unique(q.keep(q.each(q.all(x, SOURCE_ENTITY), "v", tidy(q.sub("v", r"[،؛:.][\s\S]*$", ""))), "v", "v <> ''")), 1, 2)
    issuer = f"CASE WHEN {part(1)} <> '' THEN ' ' || {part(1)} ELSE '' END"
    found = q.list(
        f"CASE WHEN {part(2)} <> '' THEN {q.s(TOPIC_BOOK[0])} || {issuer} || {q.s(TOPIC_BOOK[1])} || {part(2)} || {q.s(TOPIC_BOOK[2])} || {part(3)} || {q.s(TOPIC_BOOK[3])} END",
        f"CASE WHEN {q.find(x, amount, 1)} <> '' THEN {q.s(TOPIC_AMOUNT[0])} || {tidy(q.find(x, amount, 1))} || ' ' || {q.find(x, amount, 2)} || {q.s(TOPIC_AMOUNT[1])} END",
        f"CASE WHEN {date} <> '' THEN {q.s(TOPIC_DATE[0])} || {date} || {q.s(TOPIC_DATE[1])} END",
        f"CASE WHEN {clause} <> '' THEN {q.s(TOPIC_CLAUSE[0])} || {clause} || {q.s(TOPIC_CLAUSE[1])} END",
    )
    own = q.concat(q.keep(found, "t", "t IS NOT NULL"), q.each(parties, "p", f"{q.s(TOPIC_ENTITY[0])} || p || {q.s(TOPIC_ENTITY[1])}"))
    return f"CASE WHEN {q.size(own)} > 0 THEN {q.slice(own, 1, 3)} ELSE {q.words(TOPICS)} END"


def page_cleaning(q: Dialect) -> str:
    """Every document cleaned page-wise, with how many lines went."""
    x = q.text("text")
    return f"SELECT doc_id, {page_cleaned(q, x)} AS text, {q.size(q.lines(x))} AS n_lines, {q.size(q.keep(q.lines(x), 'v', is_artifact(q, 'v')))} AS n_artifacts FROM {q.table('documents')}"


def chunk_readings(q: Dialect) -> str:
    """Typed references, entities and numbers, topics and kinds of line of every chunk."""
    rows = f"SELECT row_id, {q.text('text')} AS x, {fold(q, q.text('text'))} AS f, {q.lines('text')} AS ps FROM {q.table('chunks')}"
    return (
        f"SELECT row_id, {q.join(typed_references(q, 'x'), ' | ')} AS typed_references, {q.join(typed_entities(q, 'x'), ' | ')} AS typed_entities, {q.join(numeric_values(q, 'x'), ' | ')} AS numeric_values, {q.join(topics(q, 'x'), ' | ')} AS topics, "
        f"{q.size(q.keep('ps', 'p', q.match('p', HEADINGS)))} AS n_headings FROM ({rows})"
    )


def english_documents(q: Dialect) -> str:
    """Category, labelled fields and section lines of every document by the English profile."""
    rows = f"SELECT doc_id, {q.text('text')} AS x, lower({q.text('text')}) AS low, {q.lines('text')} AS ps FROM {q.table('documents')}"
    name, sure = english_category(q, "low")
    fields = ", ".join(f"nullif({q.strip(q.sub(q.find('x', p, 1), r'\s+', ' '))}, '') AS {k}" for k, p in LABELLED.items())
    sections = ", ".join(f"md5({section_lines(q, 'ps', p)}) AS {k}" for k, p in SECTIONS.items())
    return f"SELECT doc_id, {name} AS category, {sure} AS confidence, {fields}, {sections}, {first_of(q, 'ps', 'p', f'CASE WHEN {q.match('p', r'^[0-9]+\.\s+')} THEN p END')} AS first_item FROM ({rows})"
