"""What a question asks for: intents, predicates, expansion and identifiers (survey 2.4, 2.10), for both engines."""

from __future__ import annotations

from sijill.functions.dialect import Dialect
from sijill.functions.extract import DATE

# Word boundaries that hold for Arabic in every regex engine.
B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
# The terms by which a question shows what it is after, as they are written; compared in searched form.
INTENT_TERMS = {
    "source_book": ["كتاب", "اعتمد", "استند", "استناد", "بناء", "المرقم بالعدد", "المؤرخ في", "رقم كتاب", "تاريخ كتاب"],
    "amount": [
        "مبلغ", "بمبلغ", "مقداره", "نسبة", "النسبة", "الى اي نسبة", "إلى أي نسبة", "عدلت النسبة", "عُدلت النسبة", "النسبة المثبتة",
        "عدلت النسبة المثبتة", "عُدلت النسبة المثبتة", "دينار", "دولار", "سعر", "كلفة", "تكلفة", "اصبح", "بدلا من",
    ],
    "date": ["تاريخ", "متى", "صدر", "صدور", "المؤرخ", "جلسة", "انعقاد"],
    "decision_number": ["رقم القرار", "قرار مجلس الوزراء", "رقم قرار", "قرر مجلس الوزراء"],
    "responsibility": ["جهة", "مسؤول", "مسؤولة", "تتحمل", "تنفذ", "تنفيذ", "وزارة", "شركة", "لجنة"],
    "summary": ["مضمون", "محتوى", "ملخص", "خلاصة", "ما الذي قرر", "ماذا قرر", "الموافقة"],
    "count": ["كم عدد", "عدد", "اعداد", "أعداد", "مجموع", "اجمالي", "إجمالي"],
    "comparison": [
        "بين اي", "بين أي", "بين اي جهتين", "بين أي جهتين", "جهتين", "بين", "بين اي جهتين ابرم عقد", "كان من المقرر إبرام",
        "كان من المقرر ابرام", "كان من المقرر إبرام عقد", "كان من المقرر ابرام عقد", "أبرم", "أُبرم", "ابرم", "إبرام", "ابرام",
    ],
}
# Patterns that add an intent, over the searched form.
INTENT_PATTERNS = {
    "amount": [B + r"(?:كم|كام|شلون|كيف).{0,30}(?:سعر|مبلغ|كلفة|تكلفة|دينار|دولار)" + E, B + r"الي?ا?\s+اي\s+نسب(?:ة|ه)" + E],
    "count": [B + r"كم\s+عدد" + E],
    "comparison": [B + r"بين\s+اي(?:\s+جهتين)?" + E, B + r"(?:ابرام|ابرمت|ابرم)(?:\s+عقد)?" + E, B + r"الي?ا?\s+اي\s+نسب(?:ة|ه)" + E],
    "source_book": [B + r"(?:شنو|ما|ماهو|ما هو|اي).{0,35}كتاب" + E],
}
# What is added to a question of each intent.
EXPANSIONS = {
    "source_book": "كتاب المرقم بالعدد المؤرخ في بناء على استنادا الى استنادا إلى اعتمد عليه",
    "amount": "مبلغ بمبلغ مقداره مقدار نسبة النسبة النسبة المثبتة الى اي نسبة إلى أي نسبة عدلت عُدلت دينار دولار سعر كلفة تكلفة اصبح بدلا من",
    "date": "تاريخ المؤرخ في صدر صدور جلسة انعقاد تاريخ صدور القرار تاريخ انعقاد الجلسة",
    "decision_number": "رقم القرار رقم قرار مجلس الوزراء قرر مجلس الوزراء decision_number",
    "responsibility": "الجهة المسؤولة تتحمل تنفيذ تنفذ وزارة شركة لجنة الالتزامات الاجراءات",
    "summary": "مضمون محتوى ملخص خلاصة قرر مجلس الوزراء الموافقة اولا ثانيا",
    "count": "كم عدد عدد اعداد أعداد مجموع اجمالي إجمالي كل جميع كافة القرارات الوثائق البنود المواد",
    "comparison": "بين اي بين أي بين اي جهتين بين أي جهتين جهتين كان من المقرر إبرام عقد ابرام إبرام أبرم أُبرم عقد تعاقد اتفاق وزارة شركة جهة طرف",
}
# Patterns of single predicates, over the question as it stands.
WHOLE_TEXT = [B + r"(?:النص|نص)\s+(?:الكامل|كامل[اً]?)" + E, B + r"(?:اعطني|أعطني|اريد|أريد)\s+(?:نص|النص).{0,30}(?:كامل|كاملا|كاملًا)" + E]
WHOLE_DOCUMENT = [
    *WHOLE_TEXT,
    B + r"(?:مضمون|ملخص|خلاصة)\s+(?:هذا\s+)?(?:القرار|الوثيقة|المستند)" + E,
    B + r"ما\s+(?:هو\s+)?(?:مضمون|محتوى)\s+(?:هذا\s+)?(?:القرار|الوثيقة|المستند)" + E,
    B + r"ما\s+الذي\s+قرره\s+مجلس\s+الوزراء" + E,
    B + r"ماذا\s+قرر\s+مجلس\s+الوزراء" + E,
]
DECISION_NUMBER = [r"(?:ما|ماهو|ما\s+هو|اذكر|اعطني|أعطني).{0,30}رقم\s+القرار", r"رقم\s+قرار\s+مجلس\s+الوزراء"]
RECOMMENDATION_NUMBER = [r"رقم.{0,30}توصية.{0,40}المجلس\s+الوزاري\s+للاقتصاد"]
SOURCE_BOOK = [
    r"(?:بناء|استناد).{0,20}(?:على|إلى|الى).{0,40}(?:اي|أي)\s+كتاب",
    r"(?:اي|أي)\s+كتاب.{0,60}(?:تعديل|عدلت|تعدلت)",
    r"كتاب.{0,40}(?:تم|جرى).{0,40}تعديل",
    r"(?:رقم|تاريخ).{0,20}كتاب",
]
SESSION_DATE = r"(?:متى|تاريخ).{0,30}(?:عقدت|انعقدت|انعقاد).{0,20}الجلسة"
ISSUE_DATE = r"(?:متى|تاريخ).{0,30}(?:صدر|صدور|اصدار|إصدار).{0,20}(?:القرار|الوثيقة)"
MULTIPLE = [
    B + r"كم\s+عدد\s+ا?ل?[\p{L}\p{N}_]+",
    B + r"(?:ما|ماهي|ما هي|اذكر|اعرض|عدد)\s+ا?ل?قرارات" + E,
    B + r"(?:كل|جميع|كافة)\s+ا?ل?قرارات" + E,
    B + r"ا?ل?قرارات\s+التي" + E,
    B + r"خلال\s+(?:سنة\s+)?(?:19|20)[0-9]{2}" + E,
    B + r"(?:قارن|مقارنة|بين)" + E,
]
FOLLOW_UP = ["هذا", "هذه", "ذلك", "المذكور", "اعلاه", "أعلاه", "نفس", "القرار", "الوثيقة", "المستند", "الكتاب", "ايضا", "أيضا", "كذلك"]
FOLLOW_UP_LEAD = r"^\s*و(?:ما|متى|كم|من|هل|ماهو|ما\s+هو)" + E
NEW_TOPIC = ["قانون رقم", "قرار رقم", "تعليمات رقم", "نظام رقم", "عقوبة", "جريمة", "قانون "]
FIELD_NOUN = B + "(?:رقم|تاريخ|مبلغ|سعر|جهة|كتاب)" + E
LAW_TERMS, FACT_TERMS = ["قانون", "تعليمات", "نظام"], ["ما هو", "ماهي", "ما هي", "كم", "مبلغ", "مدة", "طول", "رقم الطلبية", "الجهة"]
LAW_IDENTIFIER = r"رقم\s*\(?[0-9٠-٩]+\)?|لسنة\s*\(?[0-9٠-٩]{4}\)?"
GREETINGS, THANKS = ["مرحبا", "السلام عليكم", "اهلا", "أهلا", "هلو", "hello", "hi"], ["شكرا", "شكراً", "thanks", "thank you"]
SIGNALS = [
    r"[0-9]{1,2}\s*/\s*[0-9]{1,2}\s*/\s*[0-9]{4}", r"[0-9]{1,5}\s*/\s*[0-9]{1,5}(?:\s*/\s*[0-9]{2,4})?", r"(?:19|20)[0-9]{2}", r"[0-9]{1,6}(?:\.[0-9]{3})*(?:\.[0-9]+)?",
]
SIGNAL_PHRASES = [
    r"(?:وزارة|وزاره)\s+[\x{0600}-\x{06ff} ]{2,40}", r"شركة\s+[\x{0600}-\x{06ff}0-9 ]{2,50}", r"(?:السيد|الدكتور|د\.|الاستاذ)\s+[\x{0600}-\x{06ff} ]{2,40}",
    r"(?:منتوج|مادة|ماده)\s+[\x{0600}-\x{06ff} ]{2,40}", r"زيت\s+[\x{0600}-\x{06ff} ]{2,25}", r"مجلس\s+الوزراء(?:\s+العراقي)?",
]
SIGNAL_WORDS = ["قرار", "كتاب", "رقم", "وزاره", "وزارة", "شركة", "منتوج"]
#: Identifiers that an answer's context must hold: codes, dates, grouped numbers.
MARKERS = [r"[A-Z]{2,}(?:-[0-9A-Z]+)?", DATE, r"[0-9]{1,3}(?:\.[0-9]{3})+(?:\.[0-9]+)?"]


def searched(words: list[str]) -> list[str]:
    """Plain words in searched form: digits don't occur, so folding and the dropping of marks is all."""
    import re
    import unicodedata

    from sijill.functions import arabic as A

    marks = re.compile(A.DIACRITICS.replace(r"\x{", r"\u").replace("}", ""))
    return list(dict.fromkeys(marks.sub("", unicodedata.normalize("NFKC", w)).translate(str.maketrans(*A.FOLDED)).lower() for w in words))


def matches(q: Dialect, x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(q.match(x, p) for p in patterns) + ")"


def intents(q: Dialect, norm: str) -> str:
    """Names of the intents of a question in searched form, in alphabetical order."""
    flags = [f"CASE WHEN {q.any(norm, searched(INTENT_TERMS[k]))}" + (f" OR {matches(q, norm, INTENT_PATTERNS[k])}" if k in INTENT_PATTERNS else "") + f" THEN '{k}' END" for k in sorted(INTENT_TERMS)]
    return q.keep(q.list(*flags), "i", "i IS NOT NULL")


def signals(q: Dialect, norm: str) -> str:
    """Identifiers and named things in a question in searched form, in order, each once."""
    numbers = [q.whole(norm, p) for p in SIGNALS]
    phrases = [q.all(norm, p) for p in SIGNAL_PHRASES]
    # four tokens from each word whose neighbourhood names something
    windows = q.bound(q.listed(norm), "ts", q.each(q.places("ts", "i", q.inside(q.words(SIGNAL_WORDS), q.at("ts", "i"))), "i", q.join(q.slice("ts", "i", 4), " ")))
    found = q.each(q.concat(*numbers, *phrases, windows), "v", "trim(v)")
    return q.unique(q.keep(found, "v", "v <> ''"))


def expansion(q: Dialect, question: str, norm: str, found: str, signal: str) -> str:
    """A question with its searched form, what its intents add, and its signals, a line each, each once."""
    added = q.each(found, "i", "CASE i " + " ".join(f"WHEN '{k}' THEN {q.s(v)}" for k, v in EXPANSIONS.items()) + " END")
    parts = q.concat(q.list(question, norm), added, q.list(q.join(signal, " ")))
    return q.join(q.unique(q.keep(parts, "p", "p IS NOT NULL AND trim(p) <> ''")), "chr(10)")


def needs_several(q: Dialect, norm: str) -> str:
    """Whether a set of documents is asked for."""
    return matches(q, norm, MULTIPLE)


def is_follow_up(q: Dialect, question: str) -> str:
    """Whether a question goes on about the answer before it."""
    x = q.strip(q.sub(q.text(question), r"\s+", " "))
    short = f"({q.size(q.split(x, ' '))} <= 8 AND {q.match(x, FIELD_NOUN)})"
    return f"({x} <> '' AND ({q.any(x, FOLLOW_UP)} OR {q.match(x, FOLLOW_UP_LEAD)} OR (NOT {q.any(x, NEW_TOPIC)} AND {short})))"


def names_a_law(q: Dialect, question: str) -> str:
    """Whether a question looks up a law by number or year, not a fact in one."""
    x = q.text(question)
    return f"({q.any(x, LAW_TERMS)} AND NOT {q.any(x, FACT_TERMS)} AND {q.match(x, LAW_IDENTIFIER)})"


def quick_reply(q: Dialect, question: str) -> str:
    """`short`, `greeting` or `thanks` for what needs no search, else null."""
    x = q.sub(q.sub(f"lower({q.strip(q.text(question))})", r"[!؟?،,.]+$", ""), r"\s+", " ")
    among = lambda words: f"{x} IN ({', '.join(q.s(w) for w in words)})"
    return f"CASE WHEN length({x}) < 3 THEN 'short' WHEN {among(GREETINGS)} THEN 'greeting' WHEN {among(THANKS)} THEN 'thanks' END"


def date_field(q: Dialect, question: str) -> str:
    """Which date field a question asks for, null for none."""
    x = q.text(question)
    return f"CASE WHEN {q.match(x, SESSION_DATE)} THEN 'session_date' WHEN {q.match(x, ISSUE_DATE)} THEN 'issue_date' END"


def required_markers(q: Dialect, question: str) -> str:
    """Codes, dates and grouped numbers that an answer's context must hold."""
    from sijill.functions import arabic as A

    x = q.fold(q.text(question), A.DIGITS)
    return q.unique(q.concat(*[q.whole(x, p) for p in MARKERS]))


def missing_markers(q: Dialect, markers: str, context: str) -> str:
    """Markers that a context holds in none of their spellings: case, blanks, slashes and hyphens don't count."""
    flat = lambda x: q.sub(f"lower({x})", r"[\s\-ـ]+", "")
    return q.keep(markers, "m", f"NOT contains({flat(q.text(context))}, {flat('m')})")


def predicates(q: Dialect) -> str:
    """Every title read as a question: what it asks for, by every predicate."""
    x, n = "x", "n"
    fields = {
        "needs_several": needs_several(q, n),
        "is_follow_up": is_follow_up(q, x),
        "names_a_law": names_a_law(q, x),
        "quick_reply": quick_reply(q, x),
        "asks_decision_number": matches(q, x, DECISION_NUMBER),
        "asks_recommendation_number": matches(q, x, RECOMMENDATION_NUMBER),
        "asks_source_book": matches(q, x, SOURCE_BOOK),
        "wants_document": matches(q, x, WHOLE_DOCUMENT),
        "wants_whole_text": matches(q, x, WHOLE_TEXT),
        "date_field": date_field(q, x),
    }
    rows = f"SELECT search_id, {q.text('title')} AS x, {q.norm('title')} AS n FROM {q.table('search_records')}"
    return f"SELECT search_id, {', '.join(f'{v} AS {k}' for k, v in fields.items())} FROM ({rows})"


def expanded(q: Dialect) -> str:
    """Every title with its intents, signals and expansion."""
    rows = f"SELECT search_id, {q.text('title')} AS x, {q.norm('title')} AS n FROM {q.table('search_records')}"
    found = f"SELECT search_id, x, n, {intents(q, 'n')} AS i, {signals(q, 'n')} AS g FROM ({rows})"
    return f"SELECT search_id, {q.join('i', ' ')} AS intents, {q.join('g', ' | ')} AS signals, {expansion(q, 'x', 'n', 'i', 'g')} AS expansion FROM ({found})"


def markers(q: Dialect) -> str:
    """The markers of every title, and those that its own record's text lacks."""
    rows = f"SELECT s.search_id, {required_markers(q, 's.title')} AS m, l.t FROM {q.table('search_records')} s LEFT JOIN (SELECT document_id, max(long_text) AS t FROM {q.table('loaded_legal_json')} WHERE document_id IS NOT NULL GROUP BY document_id) l ON s.document_id = l.document_id"
    return f"SELECT search_id, {q.join('m', ' | ')} AS markers, {q.join(missing_markers(q, 'm', 't'), ' | ')} AS missing FROM ({rows})"
