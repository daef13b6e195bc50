"""Arabic text as column expressions; all of it stays in the JVM.

Each function has a twin that gives the same expression as SQL text, which the
correctness queries run elsewhere.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in search, and in matching a question to a document.
STOP_WORDS = ["اجابه", "اريد", "او", "الى", "عن", "على", "في", "ما", "ماهي", "من", "هل", "هو", "هي", "و"]
MATCH_STOP_WORDS = [
    "ال", "في", "من", "عن", "على", "الى", "إلى", "او", "أو", "و", "ما", "ماهو", "ماهي", "هل", "رقم", "تاريخ", "قرار",
    "كتاب", "وزارة", "مجلس", "الوزراء", "مكتب", "الوزير", "docx", "json",
]
# The marks dropped, and what makes a search token.
DIACRITICS = r"[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06ed}]"
NOT_SEARCHED = r"[^\p{L}\p{N}_\x{0600}-\x{06ff}./-]+"
TOKEN = r"[\x{0600}-\x{06ff}]+|[0-9]+(?:[/-][0-9]+)*(?:\.[0-9]+)*"
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
FOLDED = ("أإآٱىؤئ", "اااايوي")
MATCH_FOLDED = ("أإآىةؤئ", "ااايهوي")


def _compat() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility forms by Unicode's own rule: one-to-one glyphs for translate, the rest as replacements."""
    source, target, more = [], [], []
    for cp in [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFF5F), 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]:
        whole = unicodedata.normalize("NFKC", chr(cp))
        if len(whole) == 1 and whole != chr(cp):
            source.append(chr(cp))
            target.append(whole)
        elif 0xFEF5 <= cp <= 0xFEFC:
            more.append((chr(cp), whole))
    return "".join(source), "".join(target), more


COMPAT = _compat()


def fold_digits(col: Column) -> Column:
    """Arabic and Persian digits as ASCII."""
    return F.translate(col, *DIGITS)


def fold_digits_sql(x: str) -> str:
    return f"translate({x}, '{DIGITS[0]}', '{DIGITS[1]}')"


def plain_forms(col: Column) -> Column:
    """Presentation forms, full width and kinds of blank as ordinary characters."""
    out = F.translate(col, COMPAT[0], COMPAT[1])
    for glyph, whole in COMPAT[2]:
        out = F.replace(out, F.lit(glyph), F.lit(whole))
    return out


def plain_forms_sql(x: str) -> str:
    quote = lambda s: s.replace("'", "''")
    out = f"translate({x}, '{quote(COMPAT[0])}', '{quote(COMPAT[1])}')"
    for glyph, whole in COMPAT[2]:
        out = f"replace({out}, '{glyph}', '{whole}')"
    return out


def normalize_search(col: Column) -> Column:
    """The form in which texts are searched: digits, marks, hamza seats and punctuation folded, lower case; null reads as empty."""
    out = fold_digits(plain_forms(F.coalesce(col, F.lit(""))))
    out = F.replace(F.regexp_replace(out, DIACRITICS, ""), F.lit("ـ"), F.lit(""))
    return F.lower(F.trim(F.regexp_replace(F.translate(out, *FOLDED), NOT_SEARCHED, " ")))


def normalize_search_sql(x: str) -> str:
    out = fold_digits_sql(plain_forms_sql(f"coalesce({x}, '')"))
    out = f"replace(regexp_replace({out}, '{DIACRITICS}', '', 'g'), 'ـ', '')"
    return f"lower(trim(regexp_replace(translate({out}, '{FOLDED[0]}', '{FOLDED[1]}'), '{NOT_SEARCHED}', ' ', 'g')))"


def token_variants(t: Column) -> Column:
    """A token with the forms lacking its prefixes; numbers also reversed. Sorted, without stop words."""
    n = F.length(t)
    number = t.rlike("^[0-9]+$")
    forms = F.array(
        t,
        F.when(t.startswith("ال") & (n > 3), F.substring(t, 3, 10_000)),
        F.when(t.startswith("و") & (n > 3), F.substring(t, 2, 10_000)),
        F.when(t.startswith("وال") & (n > 4), F.substring(t, 4, 10_000)),
        F.when(number & (n > 1), F.reverse(t)),
    )
    return F.array_sort(F.array_except(F.array_compact(forms), F.array(*map(F.lit, STOP_WORDS))))


def search_tokens(col: Column, normalized: bool = False) -> Column:
    """Search tokens in order, each followed by its variants; repeats stay."""
    norm = col if normalized else normalize_search(col)
    raw = F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))
    kept = F.filter(raw, lambda t: ~t.isin(STOP_WORDS) & (t.rlike("^[0-9]+$") | (F.length(t) > 1)))
    return F.flatten(F.transform(kept, token_variants))


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def search_tokens_sql(x: str, normalized: bool = False) -> str:
    norm = x if normalized else normalize_search_sql(x)
    stops = _list_sql(STOP_WORDS)
    number = "regexp_full_match(t, '[0-9]+')"
    forms = (
        "[t, CASE WHEN starts_with(t, 'ال') AND length(t) > 3 THEN substring(t, 3) END, CASE WHEN starts_with(t, 'و') AND length(t) > 3 THEN substring(t, 2) END, "
        f"CASE WHEN starts_with(t, 'وال') AND length(t) > 4 THEN substring(t, 4) END, CASE WHEN {number} AND length(t) > 1 THEN reverse(t) END]"
    )
    variants = f"list_sort(list_distinct(list_filter({forms}, lambda v: v IS NOT NULL AND NOT list_contains({stops}, v))))"
    return f"flatten(list_transform(list_filter(regexp_extract_all({norm}, '{TOKEN}'), lambda t: NOT list_contains({stops}, t) AND ({number} OR length(t) > 1)), lambda t: {variants}))"


def search_blob(col: Column) -> Column:
    """The searched form, a line break, and its different tokens."""
    norm = normalize_search(col)
    tokens = F.array_join(F.array_distinct(search_tokens(norm, True)), " ")
    return F.array_join(F.filter(F.array(norm, tokens), lambda v: v != ""), "\n")


def match_text(col: Column) -> Column:
    """The form in which file and document names are compared: without extension, with teh marbuta folded."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    folded = F.replace(F.translate(stem, *MATCH_FOLDED), F.lit("ـ"), F.lit(""))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_\x{0600}-\x{06ff}]+", " "))


def match_text_sql(x: str) -> str:
    stem = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^.*/', ''), '(.)\\.[^.]*$', '\\1')"
    return f"trim(regexp_replace(replace(translate({stem}, '{MATCH_FOLDED[0]}', '{MATCH_FOLDED[1]}'), 'ـ', ''), '[^\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06ff}}]+', ' ', 'g'))"


def match_tokens(col: Column) -> Column:
    """The words that tell one document from another."""
    stops = [unicodedata.normalize("NFC", w).translate(str.maketrans(*MATCH_FOLDED)) for w in MATCH_STOP_WORDS]
    return F.array_except(F.regexp_extract_all(match_text(col), F.lit(r"[\x{0600}-\x{06ff}A-Za-z0-9]{2,}"), F.lit(0)), F.array(*map(F.lit, stops)))


def match_tokens_sql(x: str) -> str:
    stops = _list_sql([w.translate(str.maketrans(*MATCH_FOLDED)) for w in MATCH_STOP_WORDS])
    return f"list_filter(list_distinct(regexp_extract_all({match_text_sql(x)}, '[\\x{{0600}}-\\x{{06ff}}A-Za-z0-9]{{2,}}')), lambda t: NOT list_contains({stops}, t))"


def squeeze(col: Column) -> Column:
    """Line ends unified, runs of blanks squeezed, at most one empty line."""
    out = F.regexp_replace(F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def squeeze_sql(x: str) -> str:
    out = f"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"
