"""Facts taken from text by pattern, as array, struct and string columns in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sijill.functions.arabic import fold_digits

_D = "[0-9٠-٩]"
# What dates, sums, references and recommendations look like.
DATE = rf"{_D}{{1,2}}\s*/\s*{_D}{{1,2}}\s*/\s*{_D}{{4}}"
AMOUNT = rf"{_D}[0-9٠-٩.,/ ]*\s*(?:دينار|دولار)"
REFERENCE_NUMBERS = [r"المرقم\s+بالعدد\s*\(\s*([^)]+?)\s*\)", r"بالعدد\s*\(\s*([^)]+?)\s*\)", r"رقم\s+الكتاب\s*\(?\s*([0-9٠-٩A-Za-z/\\-]+)\s*\)?"]
RECOMMENDATION_NUMBERS = [r"توصية\s+المجلس\s+الوزاري\s+للاقتصاد\s*\(\s*([^)]+?)\s*\)", r"التوصية\s*\(\s*([0-9٠-٩]+\s*ق?)\s*\)"]
SESSION_DATES = [
    rf"(?:الجلسة|جلسته|جلسة)\s+.{{0,140}}?\s+المنعقد(?:ة)?\s+(?:في|بتاريخ)\s+({DATE})",
    rf"(?:الجلسة|جلسته|جلسة)\s+.{{0,140}}?\s+(?:في|بتاريخ)\s+({DATE})",
    rf"(?:عقدت|انعقدت)\s+.{{0,80}}?(?:الجلسة|جلسة)\s+.{{0,80}}?(?:في|بتاريخ)\s+({DATE})",
]
ENTITY = r"(?:وزارة|شركة|مجلس|هيئة|دائرة|محافظة|لجنة|الأمانة العامة)\s+[\x{0600}-\x{06ff}A-Za-z0-9\s]{2,60}"
YEAR = r"(?:لسنة|سنة|لعام|عام)\s*([0-9٠-٩]{4})"
NUMBER = r"رقم\s*\(?\s*([0-9٠-٩]+)\s*\)?"
# Typed references.
REFERENCES = {
    "decision_numbers": r"قرار(?:\s+مجلس\s+الوزراء)?(?:\s+رقم)?\s*\(?\s*[0-9٠-٩]+(?:\s+لسنة\s+[0-9٠-٩]+)?\s*\)?",
    "law_numbers": r"قانون\s+(?:رقم\s*)?\(?\s*[0-9٠-٩]+(?:\s+لسنة\s+[0-9٠-٩]+)?\s*\)?",
    "article_numbers": r"المادة\s*\(\s*[^)]{1,60}\)",
    "book_numbers": r"(?:كتاب(?:ها|ه|كم|نا)?(?:\s+[\x{0621}-\x{064a}]+){0,8}?\s+)?(?:المرقم(?:ة)?\s+بالعدد|بالعدد|العدد)\s*\(?\s*[^)\n]{1,50}\)",
    "recommendation_numbers": r"توصية(?:\s+[\x{0621}-\x{064a}]+){0,10}?\s*\(\s*[^)]*[0-9٠-٩][^)]*\)\s*(?:لسنة\s+[0-9٠-٩]+)?",
}
_STOP = r"(?=\s+(?:و)?(?:وزارة|شركة|لجنة|اللجنة|هيئة|مجلس|مكتب|ديوان|مشروع)|[/،,.\n()]|$)"
# Categories of entities and where their names end.
ENTITIES = {
    "ministries": r"وزارة\s+[\x{0621}-\x{064a}\s]{2,80}?" + _STOP,
    "companies": r"شركة\s+[^/،,.\n]{2,100}?" + _STOP,
    "committees": r"(?:اللجنة|لجنة)\s+[\x{0621}-\x{064a}\s]{2,100}?" + _STOP,
    "authorities": r"هيئة\s+[\x{0621}-\x{064a}\s]{2,100}?" + _STOP,
    "government_offices": r"(?:مكتب|ديوان|الأمانة\s+العامة|الامانة\s+العامة)\s+[^/،,.\n]{2,100}?" + _STOP,
    "people": r"(?:د\.|دكتور|الدكتور|السيد|السيدة)\s+[^/،,.\n-]{2,80}",
    "projects": r"مشروع\s+[^/،,.\n]{2,120}?" + _STOP,
    "councils": r"(?:مجلس|المجلس)\s+[\x{0621}-\x{064a}\s]{2,100}?" + _STOP,
}
# Rules of document types (type, terms, base confidence), of which the first best wins.
TYPE_RULES = [
    ("Cabinet Decision", ["قرار مجلس الوزراء", "مجلس الوزراء", "قرر مجلس الوزراء"], 0.94),
    ("Cabinet Recommendation", ["توصية مجلس الوزراء", "توصية المجلس", "اقرار توصية", "إقرار توصية", "المجلس الوزاري"], 0.88),
    ("Council Resolution", ["قرار مجلس", "قرر المجلس", "مجلس المحافظة", "مجلس المحافظين", "مجلس النواب"], 0.86),
    ("Law", ["قانون رقم", "باسم الشعب", "رئاسة الجمهورية", "صوت مجلس النواب", "استنادا الى احكام البند"], 0.92),
    ("Regulation", ["نظام رقم", "نظام", "انظمة", "النظام الداخلي"], 0.86),
    ("Instruction", ["تعليمات رقم", "تعليمات", "اصدرنا التعليمات", "تنفيذ التعليمات"], 0.84),
    ("Circular", ["اعمام", "اعمامنا", "يعمم", "التعميم", "الى كافة"], 0.84),
    ("Ministerial Order", ["امر وزاري", "أمر وزاري", "الامر الوزاري", "الأمر الوزاري", "امر اداري", "أمر إداري"], 0.90),
    ("Official Letter", ["وزارة", "كتابنا", "كتابكم", "إلى", "موضوع", "م/ا", "العدد", "التاريخ"], 0.74),
]
# Types of laws in order of priority, and the authorities that issue them.
GOVERNMENT_TYPES = [
    ("amendment", ["تعديل", "قانون التعديل", "تعديل قانون"]),
    ("law", ["قانون", "قانون رقم", "باسم الشعب", "رئاسة الجمهورية"]),
    ("decision", ["قرار مجلس الوزراء", "قرار رقم", "قرر مجلس الوزراء", "قرار"]),
    ("regulation", ["نظام", "النظام", "نظام رقم"]),
    ("instruction", ["تعليمات", "تعليمات رقم"]),
    ("order", ["امر ديواني", "أمر ديواني", "امر وزاري", "أمر وزاري"]),
    ("decree", ["مرسوم جمهوري", "مرسوم"]),
]
AUTHORITIES = [("مجلس الوزراء", "مجلس الوزراء"), ("رئاسة الجمهورية", "رئاسة الجمهورية|رئيس الجمهورية"), ("مجلس النواب", "مجلس النواب"), ("وزارة", r"وزارة\s+[\x{0600}-\x{06ff}\s]+")]
# What a paragraph does, by its words, in order of priority.
PARAGRAPH_TYPES = [("Approval", ["الموافقة", "يوافق"]), ("Exception", ["استثناء", "يستثني"]), ("Ratification", ["اقرار"]), ("Decision", ["قرر"]), ("Implementation", ["تتحمل", "تلتزم", "لاخذ ما يقتضي"])]


def all_of(col: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order; null reads as none."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(group))


def bounded(pattern: str) -> str:
    """Not inside a longer word or number."""
    return rf"(?<![\p{{L}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{N}}_])"


def dates(col: Column) -> Column:
    return all_of(col, bounded(DATE))


def amounts(col: Column) -> Column:
    return F.transform(all_of(col, AMOUNT), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))


def numbers_by(col: Column, patterns: list[str]) -> Column:
    """Captures of several patterns, one pattern after the other."""
    return F.concat(*[F.transform(all_of(col, p, 1), F.trim) for p in patterns])


def session_date(col: Column) -> Column:
    """The date said of a session, without blanks; null where none."""
    flat = F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " ")
    hits = [F.regexp_extract(flat, p, 1) for p in SESSION_DATES]
    return F.regexp_replace(F.coalesce(*[F.when(h != "", h) for h in hits]), r"\s+", "")


def entities(col: Column) -> Column:
    """Organisations named with their kind, up to the next mark."""
    cut = F.transform(all_of(col, ENTITY), lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"(?s)[،؛:.\n\r].*$", ""), r"\s+", " ")))
    return F.filter(cut, lambda v: v != "")


def typed_references(col: Column) -> Column:
    return F.struct(*[F.transform(all_of(col, p), F.trim).alias(k) for k, p in REFERENCES.items()])


def entity_categories(col: Column) -> Column:
    return F.struct(*[F.array_distinct(F.transform(all_of(col, p), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))).alias(k) for k, p in ENTITIES.items()])


def fold_letters(col: Column) -> Column:
    """Marks and stretching dropped, alef and yeh in one form, blanks squeezed."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x{064b}-\x{065f}\x{0670}\x{0640}]", "")
    return F.regexp_replace(F.translate(out, "أإآى", "اااي"), r"\s+", " ")


def _any(col: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return out


def paragraph_type(col: Column) -> Column:
    folded = fold_letters(col)
    out = None
    for name, words in PARAGRAPH_TYPES:
        out = F.when(_any(folded, words), name) if out is None else out.when(_any(folded, words), name)
    reference = F.coalesce(col, F.lit("")).rlike("(?:قانون|قرار|المادة|تعليمات|نظام)\\s*(?:رقم)?\\s*\\(?\\s*[0-9٠-٩]+")
    return out.when(reference, "Legal Reference").otherwise("Paragraph")


def document_type(folded: Column) -> Column:
    """struct(type, confidence): base + 0.04 for each further term, 0.98 at most; of equals the earlier rule.

    folded: a column that holds fold_letters of the text; computed in a projection before,
    it is evaluated once for all the rules' terms.
    """
    options = []
    for rank, (name, words, base) in enumerate(TYPE_RULES):
        words = [w.translate(str.maketrans("أإآى", "اااي")) for w in words]
        hits = sum((F.contains(folded, F.lit(w)).cast("int") for w in words), F.lit(0))
        conf = F.when(hits > 0, F.least(F.lit(base) + 0.04 * (hits - 1), F.lit(0.98)))
        options.append(F.when(conf.isNotNull(), F.struct(F.round(conf, 4).alias("confidence"), F.lit(-rank).alias("order"), F.lit(name).alias("type"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return F.struct(F.coalesce(best["type"], F.lit("Unknown")).alias("type"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))


def government_type(name: Column, text: Column) -> Column:
    hay = F.lower(F.concat_ws("\n", F.coalesce(name, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 3000)))
    out = None
    for kind, words in GOVERNMENT_TYPES:
        out = F.when(_any(hay, words), kind) if out is None else out.when(_any(hay, words), kind)
    return out.otherwise("unknown")


def authority(col: Column) -> Column:
    out = None
    for name, pattern in AUTHORITIES:
        hit = F.coalesce(col, F.lit("")).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def number_and_year(col: Column) -> Column:
    """struct(number, year) as a title states them, in ASCII digits; null where absent."""
    pick = lambda p: F.nullif(fold_digits(F.regexp_extract(F.coalesce(col, F.lit("")), p, 1)), F.lit(""))
    return F.struct(pick(NUMBER).alias("number"), pick(YEAR).alias("year"))


def valid_date(col: Column) -> Column:
    """Whether a d/m/yyyy text, blanks and Arabic digits allowed, is a day of the calendar; null for null."""
    plain = F.regexp_replace(fold_digits(col), r"\s+", "")
    well = plain.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")
    return F.when(col.isNotNull(), F.coalesce(well & F.try_to_timestamp(plain, F.lit("d/M/yyyy")).isNotNull(), F.lit(False)))
