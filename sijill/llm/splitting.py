"""Problem 7: splitting oversized texts at natural boundaries.

A text is read as a tree: headings by their level, list items with what follows them,
lines, sentences, words, characters. Only nodes over the limit are opened; sibling subtrees are merged
bottom-up into pieces as long as they fit. Each piece brings at most `limit - overlap`
new characters and repeats the `overlap` characters before them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sijill.session import texts

LIMIT, OVERLAP = 1400, 150
# Unicode's white space, and the marks that end a sentence.
WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
ENDS = ".؟؛:!?;"
#: The levels of the tree that pieces are cut between, from coarse to fine.
BOUNDARIES = ("line", "sentence", "word", "none")
_LINE = re.compile(r"\r?\n")
_SENTENCE = re.compile(f"(?<=[{re.escape(ENDS)}])[{WHITE}]+")
_WORD = re.compile(f"[{WHITE}]+")
_ITEM = re.compile(r"\s*(?:[\-*•–]|\(?\d{1,3}[.):\-]|\(?[٠-٩]{1,3}[.):\-]|(?:أولا|ثانيا|ثالثا|رابعا|خامسا|سادسا|سابعا|ثامنا|تاسعا|عاشرا)ً?\b)")
# Words that open a heading, by their level; `#` marks count their own.
_HEADINGS = [re.compile(rf"\s*(?:{words})(?!\w)", re.I) for words in ("الباب|Part", "الفصل|Chapter", "القسم|Section", "المادة|مادة|Article")]
_MARKUP = re.compile(r"\s*(#{1,6})\s")
HEADING_LIMIT = 80
#: Levels below the marked headings: other short lines that head what follows, list items, and plain lines.
SHORT, ITEM, PLAIN = 7, 8, 9


def _spans(text: str, start: int, end: int, cut: re.Pattern) -> list[tuple[int, int]]:
    """The parts of text[start:end] between cuts, without empty ones."""
    out, at = [], start
    for m in cut.finditer(text, start, end):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if end > at:
        out.append((at, end))
    return out


def _level(line: str) -> int:
    """Where a line stands in the tree; a short line that doesn't end like a sentence is a heading."""
    line = line.strip()
    if _ITEM.match(line):
        return ITEM
    if not line or len(line) > HEADING_LIMIT:
        return PLAIN
    if m := _MARKUP.match(line + " "):
        return len(m[1])
    for k, words in enumerate(_HEADINGS):
        if words.match(line):
            return k + 1
    return SHORT if line[-1] not in ENDS else PLAIN


class Node:
    """A heading, list item or line with what belongs to it."""

    __slots__ = ("level", "start", "end", "children")

    def __init__(self, level: int, start: int, end: int):
        self.level, self.start, self.end, self.children = level, start, end, []


class StructureTree:
    """Packs one text; `boundary` tells the finest level that had to be opened."""

    def __init__(self, text: str, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap < limit:
            raise ValueError("the overlap must be smaller than the limit")
        self.text, self.fresh, self.overlap = text, limit - overlap, overlap
        self.depth = 0

    def _merge(self, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Neighbours joined as long as they and what lies between fit."""
        out: list[tuple[int, int]] = []
        for a, b in parts:
            if out and b - out[-1][0] <= self.fresh:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _open(self, start: int, end: int, level: int) -> list[tuple[int, int]]:
        """Packed parts of a node over the limit; level: 0 line, 1 sentence, 2 word."""
        self.depth = max(self.depth, level + 1)
        if level == 2:
            return [(a, min(a + self.fresh, end)) for a in range(start, end, self.fresh)]
        parts = []
        for a, b in _spans(self.text, start, end, (_SENTENCE, _WORD)[level]):
            parts += [(a, b)] if b - a <= self.fresh else self._open(a, b, level + 1)
        return self._merge(parts)

    def tree(self) -> Node:
        """Lines under the item or heading that they follow, headings under those of a higher level."""
        root = Node(0, 0, 0)
        path = [root]
        for a, b in _spans(self.text, 0, len(self.text), _LINE):
            level = _level(self.text[a:b]) if b - a <= self.fresh else PLAIN
            while path[-1].level >= level:
                path.pop()
            node = Node(level, a, b)
            path[-1].children.append(node)
            if level < PLAIN:
                node.children.append(Node(PLAIN, a, b))
                path.append(node)
            for above in path:
                above.end = b
        return root

    def _pack(self, node: Node) -> list[tuple[int, int, bool]]:
        """(start, end, whole) of a subtree's pieces: itself if it fits, else those of its children, neighbours that fit whole merged."""
        if node.end - node.start <= self.fresh:
            return [(node.start, node.end, True)]
        if not node.children:
            return [(a, b, False) for a, b in self._open(node.start, node.end, 0)]
        out: list[tuple[int, int, bool]] = []
        for child in node.children:
            for a, b, whole in self._pack(child):
                if whole and out and out[-1][2] and b - out[-1][0] <= self.fresh:
                    out[-1] = (out[-1][0], b, True)
                else:
                    out.append((a, b, whole))
        return [(a, b, False) for a, b, _ in out]

    def pieces(self) -> list[tuple[int, int, int]]:
        """(start with overlap, start of what is new, end) of each piece, in order; between the ends only white space is left out."""
        root = self.tree()
        if not root.children:
            return []
        root.start = root.children[0].start
        return [(max(0, a - self.overlap), a, b) for a, b, _ in self._pack(root)]

    @property
    def boundary(self) -> str:
        return BOUNDARIES[self.depth]


def split_texts(df: DataFrame, key: str, field: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_key, boundary, pieces) of each value of more than `limit` code points.

    pieces: array of (start, fresh, end) in code points. Null, empty and short values
    give no row, repeated rows give theirs each, other columns are not read. The filter
    on length runs in the JVM; rows are independent, so nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            keys, out_b, out_p = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                tree = StructureTree(text, limit, overlap)
                spans = tree.pieces()
                out_p.append([{"start": s, "fresh": f, "end": e} for s, f, e in spans])
                out_b.append(tree.boundary)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("fresh", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(out_b, pa.string()), pa.array(out_p, kind)], ["row_key", "boundary", "pieces"])

    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(field).alias("v")).where(F.length("v") > limit)
    piece = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "fresh", "end")])
    return rows.mapInArrow(run, T.StructType([T.StructField("row_key", T.LongType()), T.StructField("boundary", T.StringType()), T.StructField("pieces", T.ArrayType(piece))]))


def piece_texts(df: DataFrame, key: str, field: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_key, piece, n_new, text) of every piece, oversized texts only; whole texts are cut in the worker that read them."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(k, i, e - f, text[s:e]) for i, (s, f, e) in enumerate(StructureTree(text, limit, overlap).pieces())]
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.string())], ["row_key", "piece", "n_new", "text"])

    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(field).alias("v")).where(F.length("v") > limit)
    return rows.mapInArrow(run, "row_key long, piece int, n_new int, text string")


_TABLES = [("loaded_legal_json", "record_id", "long_text"), ("chunks", "row_id", "text")]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [split_texts(texts(spark, folder, n, k, f), k, f).select(F.lit(n).alias("table_name"), "row_key", "boundary") for n, k, f in _TABLES]
    return parts[0].unionByName(parts[1])


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    parts = [piece_texts(texts(spark, folder, n, k, f), k, f).withColumn("table_name", F.lit(n)) for n, k, f in _TABLES]
    return parts[0].unionByName(parts[1])


_W = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NL = r"\r?\n"


def _longest(text: str) -> str:
    return f"list_max(list_transform(string_split_regex({text}, '{_NL}'), lambda x: length(x)))"


P7_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, {k} AS row_key,
CASE WHEN {_longest(f)} <= {LIMIT - OVERLAP} THEN 'line'
WHEN {_longest(f"regexp_replace({f}, '([.؟؛:!?;]){_W}', e'\\\\1\\n', 'g')")} <= {LIMIT - OVERLAP} THEN 'sentence'
WHEN {_longest(f"regexp_replace({f}, '{_W}', e'\\n', 'g')")} <= {LIMIT - OVERLAP} THEN 'word' ELSE 'none' END AS boundary
FROM {n} WHERE length({f}) > {LIMIT}"""
    for n, k, f in _TABLES
)
