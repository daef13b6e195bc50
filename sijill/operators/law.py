"""Sections of law texts: splitting, cleaning, laying out, scoring (survey 2.4, 2.9, 2.10), for both engines."""

from __future__ import annotations

from sijill.functions import arabic as A
from sijill.functions.dialect import Dialect
from sijill.operators.questions import B, E

_D = "0-9٠-٩۰-۹"
# What heads a law in a collection, and the words a question is asked with.
HEADING = rf"(^|\s)([{_D}]+\.\s+(?:قانون|قرار|تعليمات|نظام)\s+)"
NUMBER_YEAR = r"رقم\s*\(?\s*([0-9]+)\s*\)?.{0,40}?لسنة\s*\(?\s*([0-9]{4})\s*\)?"
STOP_TERMS = ["ما", "هو", "هي", "عن", "حول", "اريد", "أريد", "اعطني", "كل", "معلومات", "تعريف", "عرف", "قانون", "رقم", "لسنة"]
# Parts of a law text and what they are worth.
REASONS, STRUCTURE, ARTICLES, ARTICLE = "الأسباب الموجبة", "الهيكل التنظيمي", "أبرز المواد", "المادة"
BONUS = {REASONS: 100, STRUCTURE: 80, ARTICLES: 100}
# The collections' names by ten numbers each.
COLLECTIONS = [
    "تفكيك القوانين من (١) إلى (١٠) - المبادئ الدستورية والجنائية",
    "تفكيك القوانين من (١١) إلى (٢٠) - التشريعات القضائية والأمنية والاستثمارية",
    "تفكيك القوانين من (٢١) إلى (٣٠) - السياسات المالية والعمالية والتموينية",
    "تفكيك القوانين من (٣١) إلى (٤٠) - تشريعات الحوكمة الرقمية والضمان الشامل (٢٠٢٠ - ٢٠٢٦)",
]
# Suggested topics.
TOPIC_ARTICLE, TOPIC_AMOUNT, TOPIC_DATE = ("هل تريد معرفة مضمون المادة (", ") في نفس القانون؟"), ("أستطيع مساعدتك في توضيح تفاصيل المبلغ ", " الوارد في النص."), ("هل تريد معرفة دلالة تاريخ ", " في نفس النص؟")
TOPIC_REASONS, TOPIC_STRUCTURE = "هل تريد معرفة خلاصة الأسباب الموجبة في نفس النص؟", "أستطيع مساعدتك في توضيح الهيكل التنظيمي المذكور في نفس النص."
TOPICS = ["هل تريد معرفة النقطة القانونية الرئيسية التي يقررها هذا النص؟", "أستطيع مساعدتك في تحديد العبارة الأهم المرتبطة بسؤالك من نفس النص.", "هل تريد أن أراجع لك الجزء الذي يحتاج إلى قراءة تفصيلية من نفس الوثيقة؟"]
TOPICS_HEADING = "مواضيع مقترحة من نفس النص:"
_MARK = "\u001d"


def digits(q: Dialect, x: str) -> str:
    return q.fold(q.text(x), A.DIGITS)


def plain(q: Dialect, x: str) -> str:
    """Digits in ASCII, marks as blanks, lower case."""
    return f"lower({q.strip(q.sub(digits(q, x), r'[^\p{L}\p{N}_\x{0600}-\x{06ff}]+', ' '))})"


def number_year(q: Dialect, x: str) -> tuple[str, str]:
    """Number and year a question names: as written together, else the first four digits as the year and the first other number."""
    d = digits(q, x)
    numbers = q.all(d, "[0-9]+")
    year = f"coalesce({q.at(q.keep(numbers, 'n', 'length(n) = 4'), 1)}, '')"
    other = f"coalesce({q.at(q.keep(numbers, 'n', f'n <> {year}'), 1)}, '')"
    written = q.match(d, NUMBER_YEAR)
    return f"CASE WHEN {written} THEN {q.find(d, NUMBER_YEAR, 1)} ELSE {other} END", f"CASE WHEN {written} THEN {q.find(d, NUMBER_YEAR, 2)} ELSE {year} END"


def terms(q: Dialect, x: str) -> str:
    """Different words of weight in a question."""
    keep = f"length(t) > 2 AND NOT {q.inside(q.words(STOP_TERMS), 't')} AND NOT {q.match('t', '^[0-9]+$')}"
    return q.unique(q.keep(q.split(plain(q, x), " "), "t", keep))


def sections(q: Dialect, x: str) -> str:
    """A text's laws, each from its numbered heading; the whole text where there is none. Text before the first heading belongs to none."""
    parts = q.split(q.sub(x, HEADING, rf"\1{_MARK}\2"), _MARK)
    own = q.each(q.slice(parts, 2, f"greatest({q.size(parts)} - 1, 0)"), "s", q.strip("s"))
    return f"CASE WHEN {q.size(parts)} > 1 THEN {own} ELSE {q.list(x)} END"


def heading(q: Dialect, section: str) -> str:
    """The first line without its number."""
    line = q.sub(section, r"\r?\n[\s\S]*$", "")
    return q.sub(q.sub(line, rf"^[{_D}]+\.\s+", ""), "^[ :]+|[ :]+$", "")


def item_number(q: Dialect, section: str) -> str:
    return f"CAST(nullif({q.find(digits(q, section), r'(?:^|\n)\s*([0-9]{1,9})\.\s+', 1)}, '') AS BIGINT)"


def collection(q: Dialect, number: str) -> str:
    """The collection that a law's number belongs to, empty for none."""
    return "CASE " + " ".join(f"WHEN {number} BETWEEN {10 * k + 1} AND {10 * k + 10} THEN {q.s(v)}" for k, v in enumerate(COLLECTIONS)) + " ELSE '' END"


def cleaned_lines(q: Dialect, x: str) -> str:
    """Lines without collection titles and repeats; blank ones stay for the layout. As a column, `ls` in what follows."""
    drop = f"({q.match('v', '^تفكيك القوانين من')} OR ({q.has(x, 'الهيكل التنظيمي:')} AND {q.match('v', '^التنظيمي:')}))"
    return q.keep(q.each(q.split(x, r"\r?\n"), "v", q.strip("v")), "v", f"NOT {drop}")


def cleaned(q: Dialect, ls: str = "ls") -> str:
    """The lines joined: each text once, at most one blank line between."""
    keep = q.places(ls, "i", f"{q.at(ls, 'i')} = '' OR {q.position(ls, q.at(ls, 'i'))} = i")
    return q.strip(q.sub(q.join(q.each(keep, "i", q.at(ls, "i")), "chr(10)"), r"\n{3,}", "\n\n"))


def formatted(q: Dialect, lines: str) -> str:
    """Non-blank lines, the parts and articles with a bullet."""
    lead = f"CASE WHEN {q.match('v', f'^(?:{REASONS}:|{STRUCTURE}:|{ARTICLES}|{ARTICLE})')} AND NOT {q.match('v', rf'^[{_D}]+\.\s+')} THEN '•' || chr(9) ELSE '' END"
    return q.strip(q.join(q.each(lines, "v", f"{lead} || v"), "chr(10)"))


def summary(q: Dialect, lines: str, n: int = 3) -> str:
    """The first lines that are no articles, up to where the articles begin; `lines` is a column without repeats."""
    stop = f"coalesce({q.at(q.places(lines, 'i', q.match(q.at(lines, 'i'), f'^{ARTICLES}')), 1)}, {q.size(lines)} + 1)"
    own = q.keep(q.slice(lines, 1, f"{stop} - 1"), "v", f"NOT {q.match('v', f'^{ARTICLE}')}")
    return q.join(q.slice(own, 1, n), "chr(10)")


def topics(q: Dialect, x: str) -> str:
    """Up to three topics to go on with, from what the text holds."""
    article = q.find(x, rf"المادة\s*\(?\s*([0-9٠-٩]+)\s*\)?", 1)
    amount = r"([0-9٠-٩][0-9٠-٩.,/ ]+)\s*(دينار|دولار)"
    date = q.find(x, B + r"([0-9٠-٩]{1,2}\s*/\s*[0-9٠-٩]{1,2}\s*/\s*[0-9٠-٩]{4})" + E, 1)
    value = q.strip(q.sub(q.find(x, amount, 1), r"\s+", " "))
    found = q.list(
        f"CASE WHEN {article} <> '' THEN {q.s(TOPIC_ARTICLE[0])} || {article} || {q.s(TOPIC_ARTICLE[1])} END",
        f"CASE WHEN {value} <> '' THEN {q.s(TOPIC_AMOUNT[0])} || {value} || ' ' || {q.find(x, amount, 2)} || {q.s(TOPIC_AMOUNT[1])} END",
        f"CASE WHEN {date} <> '' THEN {q.s(TOPIC_DATE[0])} || {date} || {q.s(TOPIC_DATE[1])} END",
        f"CASE WHEN {q.has(x, REASONS)} THEN {q.s(TOPIC_REASONS)} END",
        f"CASE WHEN {q.has(x, STRUCTURE)} THEN {q.s(TOPIC_STRUCTURE)} END",
    )
    own = q.keep(found, "t", "t IS NOT NULL")
    return f"CASE WHEN {q.size(own)} > 0 THEN {q.slice(own, 1, 3)} ELSE {q.words(TOPICS)} END"


def with_topics(q: Dialect, answer: str, x: str) -> str:
    """An answer with its topics, unless it has some or is empty."""
    listed = q.join(q.each(topics(q, x), "t", "'- ' || t"), "chr(10)")
    return f"CASE WHEN {answer} = '' OR {q.has(answer, TOPICS_HEADING)} OR {q.has(answer, 'مواضيع مقترحة:')} THEN {answer} ELSE {q.strip(answer)} || chr(10) || chr(10) || {q.s(TOPICS_HEADING)} || chr(10) || {listed} END"


def detail_bonus(q: Dialect, x: str) -> str:
    """What a section's parts and length are worth."""
    parts = " + ".join(f"CASE WHEN {q.has(x, w)} THEN {n} ELSE 0 END" for w, n in BONUS.items())
    return f"({parts} + least({q.size(q.all(x, ARTICLE))}, 8) * 30 + CASE WHEN length({x}) > 500 THEN 40 ELSE 0 END)"


def section_score(q: Dialect, own_terms: str, number: str, year: str, searchable: str, section: str) -> str:
    """Five for each term, 80 and 60 for number and year, the bonus; nothing where both are asked for and not both are there."""
    shared = f"{q.size(q.both(own_terms, q.split(searchable, ' ')))} * 5"
    by_number = f"({number} <> '' AND {q.inside(q.all(searchable, r'رقم\s*\(?\s*([0-9]+)', 1), number)})"
    by_year = f"({year} <> '' AND contains({searchable}, {year}))"
    identified = f"(CASE WHEN {by_number} THEN 80 ELSE 0 END + CASE WHEN {by_year} THEN 60 ELSE 0 END)"
    law = f"CASE WHEN {q.has(searchable, 'قانون')} THEN 5 ELSE 0 END"
    return f"CASE WHEN {number} <> '' AND {year} <> '' AND NOT ({by_number} AND {by_year}) THEN 0 WHEN {shared} + {identified} = 0 THEN 0 ELSE {shared} + {identified} + {law} + {detail_bonus(q, section)} END"


def law_sections(q: Dialect) -> str:
    """The sections of every record's text: heading, number, collection, bonus and layout."""
    rows = f"SELECT record_id, {q.rows(sections(q, 'x'))} AS s FROM (SELECT record_id, {q.text('long_text')} AS x FROM {q.table('loaded_legal_json')})"
    lines = f"SELECT record_id, s, {cleaned_lines(q, 's')} AS ls FROM ({rows})"
    plain_lines = f"SELECT record_id, s, ls, {q.unique(q.keep('ls', 'v', f'v <> {q.s('')}'))} AS ps FROM ({lines})"
    number = item_number(q, "s")
    return (
        f"SELECT record_id, {heading(q, 's')} AS heading, {number} AS item_number, {collection(q, number)} AS collection, CAST({detail_bonus(q, 's')} AS BIGINT) AS bonus, "
        f"md5({cleaned(q)}) AS cleaned, md5({formatted(q, 'ps')}) AS formatted, coalesce(nullif({summary(q, 'ps')}, ''), {formatted(q, 'ps')}) AS summary, {q.join(topics(q, 's'), ' | ')} AS topics, md5({with_topics(q, summary(q, 'ps'), 's')}) AS answer FROM ({plain_lines})"
    )


def law_scores(q: Dialect) -> str:
    """How well each record's own sections answer its registered title: the best score of each registration."""
    number, year = number_year(q, "title")
    asked = f"SELECT search_id, document_id, {terms(q, 'title')} AS ts, {number} AS n, {year} AS y FROM {q.table('search_records')} WHERE title IS NOT NULL"
    rows = f"SELECT document_id, {q.rows(sections(q, 'x'))} AS s FROM (SELECT document_id, {q.text('long_text')} AS x FROM {q.table('loaded_legal_json')} WHERE document_id IS NOT NULL)"
    searched = f"SELECT document_id, s, {plain(q, f'{heading(q, 's')} || chr(10) || s')} AS p FROM ({rows})"
    scored = f"SELECT search_id, {section_score(q, 'ts', 'n', 'y', 'p', 's')} AS score FROM ({asked}) a JOIN ({searched}) b ON a.document_id = b.document_id"
    return f"SELECT search_id, CAST(max(score) AS BIGINT) AS score, max(score) >= 60 AS found FROM ({scored}) GROUP BY search_id"
