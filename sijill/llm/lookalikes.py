"""Problem 2: text that looks the same but is stored as different characters.

Pairs of strings that look alike are united into transitive classes (union-find over
strings and code points). The most frequent member of a class, counted over all rows,
represents it. A multi-pattern automaton then rewrites each text greedily, longest
pattern first, into representatives; texts that read alike come out equal.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.llm.mojibake import SUSPICIOUS, restore_all
from sijill.session import materialize, texts

# Letters, digits and marks of the same look; each group is one class.
SAME_LOOK = """
AΑА BΒВ CСϹ EΕЕ HΗН IΙІӀ JЈ KΚК MΜМ NΝ OΟО PΡР SЅ TΤТ XΧХ YΥҮ ZΖ GԌ QԚ WԜ VѴ
aа cсϲ dԁ eе hһ iі jјϳ lӏ oοо pр qԛ sѕ vνѵ wԝ xх yу µμ
ΓГ ΠП ΦФ
٠۰ ١۱ ٢۲ ٣۳ ٧۷ ٨۸ ٩۹
-‐‑‒–−﹣⁃ /∕⁄⧸
"""
#: Code points without a look of their own.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0x0D, *range(0x180B, 0x180E), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0x1D173, 0x1D17B), 0xE0001, *range(0xE0020, 0xE0080), *range(0xE0100, 0xE01F0)]
# Arabic letters that look like another one only where they join the next letter, or only where they don't.
JOINED = {"ی": "ي", "ک": "ك", "ھ": "ه"}
UNJOINED = {"ی": "ى", "ە": "ه"}
#: Private code points for the joined and unjoined shapes.
_SHAPE = {**{(c, True): chr(0xE000 + i) for i, c in enumerate(JOINED)}, **{(c, False): chr(0xE010 + i) for i, c in enumerate(UNJOINED)}}
#: Letters that join to the right, so that a letter before them takes its joined shape; the marks between don't count.
_JOINING = re.compile("[آ-غـ-يٱ-ٴٷ-ۓەۮۯۺ-ۿ-]")
_TRANSPARENT = re.compile("[ً-ٰٟۖ-ۭ]*")
_SHAPED = re.compile("([ی]|[کھ]|ە)")


class UnionFind:
    """Transitive classes of strings, with path halving and union by size."""

    def __init__(self):
        self.parent: dict[str, str] = {}
        self.size: dict[str, int] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        self.size.setdefault(x, 1)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values()]


@lru_cache(maxsize=1)
def alike() -> list[list[str]]:
    """The look-alike classes, from Unicode's own decompositions and the fixed groups above."""
    uf = UnionFind()
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        ch = chr(cp)
        tag, _, parts = unicodedata.decomposition(ch).partition(" ")
        if tag in ("<initial>", "<medial>", "<final>", "<isolated>", "<wide>", "<narrow>"):
            whole = unicodedata.normalize("NFKC", ch)
            if not whole.startswith(" "):
                uf.union(ch, whole)
        elif unicodedata.category(ch) == "Zs":
            uf.union(ch, " ")
        elif tag and not tag.startswith("<") and parts and (cp < 0x700 or 0x1E00 <= cp < 0x2000):
            # composed and decomposed writing
            uf.union(unicodedata.normalize("NFC", ch), unicodedata.normalize("NFD", ch))
    for group in SAME_LOOK.split():
        for ch in group[1:]:
            uf.union(group[0], ch)
    for cp in INVISIBLE:
        uf.union("", chr(cp))
    for (letter, joined), shape in _SHAPE.items():
        uf.union(shape, (JOINED if joined else UNJOINED)[letter])
    for letter in JOINED:
        if letter not in UNJOINED:
            uf.find(letter)
    return [c for c in uf.classes() if len(c) > 1]


def _shaped(text: str) -> str:
    """Letters whose look depends on joining, as the shape they take here."""
    out, last = [], 0
    for m in _SHAPED.finditer(text):
        after = _TRANSPARENT.match(text, m.end()).end()
        joined = bool(after < len(text) and _JOINING.match(text, after))
        shape = _SHAPE.get((m[0], joined))
        if shape:
            out += [text[last : m.start()], shape]
            last = m.end()
    return "".join(out) + text[last:] if out else text


class Rewriter:
    """The automaton for given frequencies: text to its representative form."""

    def __init__(self, counts: dict[str, int]):
        self.automaton = ahocorasick.Automaton()
        self.single: dict[int, str] = {}
        singles: set[str] = set()
        # a string of several characters is at most as frequent as its rarest one
        often = lambda m: min((counts.get(ch, 0) for ch in m), default=0)
        for members in alike():
            best = "" if "" in members else min(members, key=lambda m: (-often(m), len(m), m))
            for m in members:
                if m and m != best:
                    self.automaton.add_word(m, (len(m), best))
                    singles.add(min(m, key=lambda ch: counts.get(ch, 0)))
                elif m and len(m) == 1:
                    # a representative still wins over patterns inside longer ones
                    self.automaton.add_word(m, (len(m), m))
        self.automaton.make_automaton()
        self.rare = sorted(singles | {"ی", "ک", "ھ", "ە"})

    def __call__(self, text: str) -> str:
        # the letters' shapes are settled once the presentation forms and invisible marks are out
        text = self._pass(unicodedata.normalize("NFC", text))
        shaped = _shaped(text)
        return text if shaped == text else self._pass(shaped)

    def _pass(self, text: str) -> str:
        out, last = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            start = end - n + 1
            out += [text[last:start], to]
            last = end + 1
        return unicodedata.normalize("NFC", "".join(out) + text[last:]) if out else text

    def gate(self) -> str:
        """Java pattern of texts that the automaton may change; all others are their own form.

        It names the characters that are certainly kept, a few ranges, so that one scan
        of a clean text settles it: ASCII, Latin and Arabic letters, marks and
        digits without the rare members among them.
        """
        rare = {ord(ch) for ch in self.rare}
        letters = (*range(0xC0, 0x180), 0x60C, 0x61B, 0x61F, *range(0x621, 0x651), 0x652, *range(0x660, 0x66A))  # shadda may stand on either side of a vowel
        keep = [c for c in (0x9, 0xA, *range(0x20, 0x7F), *letters) if c not in rare]
        spans: list[list[int]] = []
        for c in keep:
            if spans and c == spans[-1][1] + 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        # ranges are tried in order: what these texts are mostly made of comes first
        spans.sort(key=lambda x: (not 0x600 <= x[0] < 0x700, x[0] - x[1]))
        chars = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)
        return rf"[^{chars}]"


def class_counts(rows: DataFrame, field: str) -> dict[str, int]:
    """How often each character of a class's members occurs, over all rows.

    Counting is vectorised per batch; what reaches the driver is one number for each
    member of the fixed classes, however large the table.
    """
    members = sorted({ord(ch) for c in alike() for m in c for ch in m})

    def count(batches):
        at = np.array(members)
        total = np.zeros(len(members), np.int64)
        for batch in batches:
            text = "".join(v for v in batch.column(0).to_pylist() if v)
            a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            total += np.bincount(a, minlength=0x110000)[at]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[hit], pa.int32()), pa.array(total[hit], pa.int64())], ["cp", "n"])

    out = rows.select(field).where(F.col(field).isNotNull()).mapInArrow(count, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {chr(r.cp): r.n for r in out}


def reading_forms(df: DataFrame, key: str, field: str, counts: dict[str, int] | None = None) -> DataFrame:
    """(key, stored, form): digests of the stored value and of its representative form.

    Garbled and null values are left out; an empty text is its own form. Texts without
    any rare member are their own form and never leave the JVM; two texts read alike
    if and only if their forms are equal (128-bit digests stand for the texts). The
    three narrow columns are written once and read by every step that follows.
    """
    rewriter = Rewriter(class_counts(df, field) if counts is None else counts)
    shown = F.replace(F.col("v"), F.lit("\r"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(field).alias("v")).where(F.col("v").isNotNull())
    # one scan of each text; only those with rare members are sent on
    once = rows.select(
        "key",
        F.md5(F.col("v").cast("binary")).alias("stored"),
        F.when(F.contains(F.col("v"), F.lit("\r")), F.md5(shown.cast("binary"))).alias("shown"),
        F.when(shown.rlike(rewriter.gate()), shown).alias("dirty"),
    )

    def rewrite(batches):
        doubtful = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", SUSPICIOUS))
        for batch in batches:
            keys, stored, plain, dirty = (batch.column(i).to_pylist() for i in range(4))
            at = [i for i, v in enumerate(dirty) if v is not None]
            forms = [s if p is None else p for s, p in zip(stored, plain)]
            for i, (garbled, _) in zip(at, restore_all([dirty[i] if doubtful.search(dirty[i]) else "" for i in at])):
                forms[i] = None if garbled else hashlib.md5(rewriter(dirty[i]).encode("utf-8", "surrogatepass")).hexdigest()
            keep = [i for i, f in enumerate(forms) if f is not None]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.int64()), pa.array([stored[i] for i in keep], pa.string()), pa.array([forms[i] for i in keep], pa.string())], ["key", "stored", "form"])

    return materialize(once.mapInArrow(rewrite, "key long, stored string, form string"), "reading-forms")


def look_alike_rows(forms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of classes that hold more than one stored text. One combining aggregate finds them; classes of one text, exact copies among them, end here."""
    keys = [*by, "form"]
    mixed = forms.groupBy(*keys).agg(F.min("stored").alias("least"), F.max("stored").alias("most")).where("least <> most").select(*keys)
    return forms.join(mixed, keys, "left_semi")


def look_alike_pairs(forms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key_a, key_b) of all rows whose texts read alike but are stored differently.

    Different stored texts of a class are paired first, their rows after that, so exact
    copies of one another are never paired. Every pair is listed, as the result is defined;
    `look_alike_links` gives the same links in a size that grows as the rows do. Classes
    are compared within equal values of the columns `by`.
    """
    keys = [*by, "form"]
    rows = materialize(look_alike_rows(forms, by), "look-alike-rows")
    variants = rows.select(*keys, "stored").distinct()
    texts = variants.withColumnRenamed("stored", "stored_a").join(variants.withColumnRenamed("stored", "stored_b"), keys).where("stored_a < stored_b")
    row = lambda side, name: rows.select(*keys, F.col("stored").alias(f"stored_{side}"), F.col("key").alias(name))
    pairs = texts.join(row("a", "key_1"), [*keys, "stored_a"]).join(row("b", "key_2"), [*keys, "stored_b"])
    return pairs.select(*by, F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b"))


def look_alike_links(forms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key, class_id, n_rows, n_texts): each row's class, and how many rows and stored texts it has.

    A row has as many partners stored otherwise as its class has rows of other texts;
    counts combine before their shuffle, so a class that a third of the rows share costs
    no task more than others.
    """
    keys = [*by, "form"]
    texts = forms.groupBy(*keys, "stored").agg(F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
    return forms.join(classes, keys).select(*by, "key", F.col("form").alias("class_id"), "n_rows", "n_texts")


_FIELDS = [("search_records", "search_id", "title"), ("search_records", "search_id", "decision_number"), ("chunks", "row_id", "text")]


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    parts = [reading_forms(texts(spark, folder, n, k, f), k, f).select(F.lit(n).alias("table_name"), F.lit(f).alias("field"), "key", "stored", "form") for n, k, f in _FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_pairs(_forms(spark, folder), by=("table_name", "field"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each row of each field with the digest that texts reading alike share, and the rows and stored texts that share it."""
    return look_alike_links(_forms(spark, folder), by=("table_name", "field")).withColumnRenamed("key", "row_key")
