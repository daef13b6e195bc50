"""Problem 9: evaluation texts leaking into training text.

The normalised words of all test items form one generalised suffix automaton. Training
texts stream through it word by word, which gives at each word the longest match with
any item; where a match is long enough the state names the items. Spans over the limits
can be removed from the text.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.functions.dialect import DUCK
from sijill.session import table, texts

MIN_WORDS = 12
#: A text with a greater share of leaked words than this is dropped whole by clean_texts.
MAX_COVERAGE = 0.5
#: Item words in one automaton, which goes to every worker (some 0.4 KB a word there); more items make more automata.
MAX_ITEM_WORDS = 1_000_000

_FOLD = str.maketrans("أإآٱ", "اااا", "ـ")
_WORD = re.compile(r"[^\W_]+")


def words(token: str) -> list[str]:
    """The normalised words in a piece of text without blanks (or with them).

    Case, vowel and other combining marks, stretching, invisible marks, hamza or madda
    on alef, shapes, width and the script of digits are folded; all else parts words.
    """
    if token.isascii():
        return _WORD.findall(token.lower())
    out = []
    for ch in unicodedata.normalize("NFKC", token).translate(_FOLD).casefold():
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Me", "Cf"):
            continue
        out.append(str(unicodedata.digit(ch)) if kind == "Nd" else ch)
    return _WORD.findall("".join(out))


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, items: dict[int, str] | list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.vocabulary: dict[str, int] = {}
        ends: list[set[int]] = [set()]
        n = 0
        for item, text in items.items() if isinstance(items, dict) else items:
            last = 0
            for word in words(text or ""):
                n += 1
                if n > MAX_ITEM_WORDS:
                    raise ValueError("more test words than the automaton is bounded to")
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), ends)
                ends[last].add(item)
        # items of a state: its own and those of all states that end in it
        for state in sorted(range(len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[state] > 0 and self.len[self.link[state]] >= min_words:
                ends[self.link[state]] |= ends[state]
        self.items = [tuple(sorted(e)) if length >= min_words else () for e, length in zip(ends, self.len)]
        self._flatten()

    def _flatten(self) -> None:
        """All moves in one table, keyed by state and word together: a third of the memory of a table for each state."""
        self.moves = {state << 32 | word: to for state, moves in enumerate(self.next) for word, to in moves.items()}
        self.next = None

    def __getstate__(self) -> dict:
        """Plain arrays on the way to the workers."""
        n = len(self.moves)
        counts = np.fromiter(map(len, self.items), np.int64, len(self.items))
        return {
            "min_words": self.min_words,
            "vocabulary": "\n".join(self.vocabulary),
            "keys": np.fromiter(self.moves.keys(), np.int64, n),
            "targets": np.fromiter(self.moves.values(), np.int32, n),
            "link": np.array(self.link, np.int32),
            "len": np.array(self.len, np.int32),
            "item_counts": counts,
            "items": np.fromiter((i for own in self.items for i in own), np.int64, int(counts.sum())),
        }

    def __setstate__(self, state: dict) -> None:
        self.min_words, self.next = state["min_words"], None
        self.vocabulary = {w: i for i, w in enumerate(state["vocabulary"].split("\n"))} if state["vocabulary"] else {}
        self.moves = dict(zip(state["keys"].tolist(), state["targets"].tolist()))
        self.link, self.len = state["link"].tolist(), state["len"].tolist()
        ends = state["item_counts"].cumsum().tolist()
        flat = state["items"].tolist()
        self.items = [tuple(flat[e - n : e]) for e, n in zip(ends, state["item_counts"].tolist())]

    def _add(self, length: int, link: int, moves: dict, ends: list) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(moves)
        ends.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, word, q, ends)
        new = self._add(self.len[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, word, q, ends)
        return new

    def _clone(self, p: int, word: int, q: int, ends: list) -> int:
        copy = self._add(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matches(self, numbers: list[int]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, item) of each maximal run of shared words of at least min_words.

        Numbers of unknown words are negative. A run is reported for the items that hold
        any of its windows of min_words.
        """
        found: dict[int, list[list[int]]] = {}
        state = length = 0
        moves = self.moves
        for at, word in enumerate(numbers):
            if word < 0:
                state = length = 0
                continue
            to = moves.get(state << 32 | word)
            while to is None and state:
                state = self.link[state]
                length = self.len[state]
                to = moves.get(state << 32 | word)
            state = to or 0
            length = length + 1 if state else 0
            if length >= self.min_words:
                top = state
                while self.len[self.link[top]] >= self.min_words:
                    top = self.link[top]
                for item in self.items[top]:
                    runs = found.setdefault(item, [])
                    start = at + 1 - self.min_words
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = at + 1
                    else:
                        runs.append([start, at + 1])
        return [(a, b, item) for item, runs in found.items() for a, b in runs]


class Reader:
    """Texts to word numbers; each different token is normalised once per worker."""

    def __init__(self, automaton: SuffixAutomaton, keep: int = 500_000):
        self.automaton, self.keep = automaton, keep
        self.known: dict[str, list[int]] = {}

    def token(self, raw: str) -> list[int]:
        got = self.known.get(raw)
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[raw] = [self.automaton.vocabulary.get(w, -1) for w in words(raw)]
        return got

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        known, numbers = self.known, []
        for raw in text.split():
            got = known.get(raw)
            numbers += self.token(raw) if got is None else got
        return self.automaton.matches(numbers) if len(numbers) >= self.automaton.min_words else []

    def characters(self, text: str, spans) -> tuple[list[tuple[int, int]], float]:
        """The spans' places in the text, blanks-separated tokens whole, and the share of words they cover."""
        at: list[tuple[int, int]] = []
        for m in re.finditer(r"\S+", text):
            at += [m.span()] * len(self.token(m[0]))
        covered = sorted({i for a, b, _ in spans for i in range(a, b)})
        places: list[list[int]] = []
        for k, i in enumerate(covered):
            if k and covered[k - 1] == i - 1:
                places[-1][1] = at[i][1]
            else:
                places.append([at[i][0], at[i][1]])
        return [tuple(p) for p in places], len(covered) / len(at)


def automata_of(items: DataFrame, key: str, field: str, min_words: int = MIN_WORDS, most: int = MAX_ITEM_WORDS) -> list[SuffixAutomaton]:
    """Automata over all items, each of at most `most` words.

    Test material is held out by hand; it is read to the driver item by item. An item that
    is larger than an automaton is laid into several, each part with the last min_words - 1
    words of the one before, so every window of min_words stands whole in one of them.
    """
    rows = items.select(F.col(key).cast("long"), F.col(field)).where(F.col(field).isNotNull()).orderBy(key, field).toLocalIterator()
    done: list[SuffixAutomaton] = []
    held: list[tuple[int, str]] = []
    size = 0
    for item, text in rows:
        own = words(text)
        for at in range(0, max(1, len(own) - min_words + 1), most - min_words + 1):
            part = own[at : at + most]
            if held and size + len(part) > most:
                done.append(SuffixAutomaton(held, min_words))
                held, size = [], 0
            held.append((item, " ".join(part)))
            size += len(part)
    return [*done, SuffixAutomaton(held, min_words)]


def leaked_items(documents: DataFrame, key: str, field: str, automata: list[SuffixAutomaton]) -> DataFrame:
    """(key, item_id, first_word, end_word) of each leaked run of words; the documents are read once for each automaton.

    Null, empty and short texts and empty tables give no rows; repeated documents give
    theirs each; other columns are not read. Documents are independent: no shuffle.
    """
    parts = [_leaked(documents, key, field, a) for a in automata]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _leaked(documents: DataFrame, key: str, field: str, automaton: SuffixAutomaton) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            out = [(k, item, a, b) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, item in reader.spans(text)]
            if out:
                k, item, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(item, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], [key, "item_id", "first_word", "end_word"])

    rows = documents.select(F.col(key).cast("long").alias(key), field).where(F.col(field).isNotNull())
    return rows.mapInArrow(run, f"`{key}` long, item_id long, first_word int, end_word int")


def clean_texts(documents: DataFrame, key: str, field: str, automata: list[SuffixAutomaton], max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """(key, text, coverage) of the documents with leaks: leaked spans cut out, null text where they cover more than max_coverage. All automata are held at once."""
    shared = documents.sparkSession.sparkContext.broadcast(automata)

    def run(batches):
        readers = [Reader(a) for a in shared.value]
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans := [s for reader in readers for s in reader.spans(text)]:
                    places, coverage = readers[0].characters(text, spans)
                    for a, b in reversed(places):
                        text = text[:a] + text[b:]
                    out.append((k, text if coverage <= max_coverage else None, coverage))
            if out:
                k, text, coverage = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(text, pa.string()), pa.array(coverage, pa.float64())], [key, "text", "coverage"])

    rows = documents.select(F.col(key).cast("long").alias(key), field).where(F.col(field).isNotNull())
    return rows.mapInArrow(run, f"`{key}` long, text string, coverage double")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    automata = automata_of(table(spark, folder, "eval_items"), "item_id", "item_text")
    # an item may leak in several places of a document: they are merged in the row's own task
    leaks = leaked_items(texts(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", automata)
    return leaks.select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    automata = automata_of(table(spark, folder, "eval_items"), "item_id", "item_text")
    return clean_texts(texts(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", automata)


# the same cases by windows of words, for the other engine
def _words_sql(x: str) -> str:
    plain = DUCK.fold(DUCK.sub(f"nfc_normalize({DUCK._plain(x)})", r"[\p{Mn}\p{Me}\p{Cf}ـ]", ""), ("أإآٱ" + A.DIGITS[0], "اااا" + A.DIGITS[1]))
    return DUCK.all(f"lower({plain})", r"[\p{L}\p{N}]+")


_WINDOWS = f"list_transform(range(1, len(w) - {MIN_WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {MIN_WORDS - 1}), ' '))"
P9_SQL = (
    f"WITH i AS (SELECT item_id, {_words_sql('item_text')} AS w FROM eval_items WHERE item_text IS NOT NULL), d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL), "
    f"a AS (SELECT DISTINCT item_id, unnest({_WINDOWS}) AS x FROM i), b AS (SELECT doc_id, unnest({_WINDOWS}) AS x FROM d) SELECT DISTINCT doc_id, item_id FROM b JOIN a USING (x)"
)
