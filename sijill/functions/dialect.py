"""One definition, two engines: SQL text of expressions for Spark and for DuckDB.

An operator written against a Dialect gives the expression that Catalyst plans and the
one that checks it elsewhere. `column` makes a Spark column of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.session import spread, table


class Dialect:
    """Expressions over SQL text; `x` is always an expression, `words` and patterns are plain values."""

    duck = False

    # --- values
    def s(self, value: str) -> str:
        """A string literal."""
        return f'r"{value}"' if "'" in value else f"r'{value}'"

    def list(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def words(self, words) -> str:
        return self.list(*map(self.s, words))

    def table(self, name: str) -> str:
        return f"sijill_{name}"

    # --- text
    def text(self, x: str) -> str:
        return f"coalesce({x}, '')"

    def strip(self, x: str) -> str:
        """Without white space at both ends."""
        return self.sub(x, r"^\s+|\s+$", "")

    def first(self, *xs: str) -> str:
        """The first that isn't blank, stripped; else empty."""
        return "coalesce(" + ", ".join(f"nullif({self.strip(x)}, '')" for x in xs) + ", '')"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.s(pattern)})"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        """The first match, empty without one."""
        return f"regexp_extract({x}, {self.s(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.s(pattern)}, {group})"

    def whole(self, x: str, pattern: str) -> str:
        """All matches that don't stand inside a longer word or number; for patterns of ASCII letters, digits and marks."""
        return self.all(x, rf"(?<![\p{{L}}\p{{N}}_])({pattern})(?![\p{{L}}\p{{N}}_])", 1)

    def sub(self, x: str, pattern: str, by: str) -> str:
        """All matches replaced; `\\1` stands for a group."""
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(re.sub(r'\\(\d)', r'$\1', by))})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.s(pattern)})"

    def has(self, x: str, word: str) -> str:
        return f"contains({x}, {self.s(word)})"

    def any(self, x: str, words) -> str:
        return "(" + " OR ".join(self.has(x, w) for w in words) + ")"

    def cut(self, x: str, n: int) -> str:
        return f"substring({x}, 1, {n})"

    def fold(self, x: str, pairs: tuple[str, str]) -> str:
        return f"translate({x}, {self.s(pairs[0])}, {self.s(pairs[1])})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, {self.s(path)})"

    def valid(self, x: str) -> str:
        """Whether a text is complete JSON."""
        return f"(try_parse_json({x}) IS NOT NULL)"

    def payload(self, x: str) -> str:
        """A stored payload as the JSON object it holds: marks before it dropped, text that wraps it (up to twice) taken off; null otherwise."""
        bare = lambda v: self.sub(v, r"^[\s\x{FEFF}]+", "")
        unwrap = lambda v: f"CASE WHEN {self.match(v, '^[\"]')} AND {self.valid(v)} THEN {bare(self.json(v, '$'))} ELSE {v} END"
        out = unwrap(unwrap(bare(x)))
        return f"CASE WHEN {self.match(out, '^[{]')} AND {self.valid(out)} THEN {out} END"

    # --- lists
    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def at(self, x: str, i: int | str) -> str:
        """The i-th from 1; null beyond the end."""
        return f"get({x}, {i} - 1)"

    def each(self, x: str, v: str, body: str) -> str:
        return f"transform({x}, {v} -> {body})"

    def keep(self, x: str, v: str, condition: str) -> str:
        return f"filter({x}, {v} -> {condition})"

    def some(self, x: str, v: str, condition: str) -> str:
        return f"exists({x}, {v} -> {condition})"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, {by if by.startswith('chr(') else self.s(by)})"

    def unique(self, x: str) -> str:
        """Each value once, in order."""
        return f"array_distinct({x})"

    def both(self, x: str, y: str) -> str:
        """Different values in both lists."""
        return f"array_intersect({x}, {y})"

    def concat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def slice(self, x: str, start: int | str, n: int | str) -> str:
        return f"slice({x}, {start}, {n})"

    def inside(self, x: str, v: str) -> str:
        return f"array_contains({x}, {v})"

    def places(self, x: str, i: str, condition: str) -> str:
        """Numbers from 1 to the list's size for which a condition on the number holds."""
        return f"filter(sequence(1, greatest(size({x}), 1)), {i} -> {i} <= size({x}) AND ({condition}))"

    def lines(self, x: str) -> str:
        """Non-blank lines, stripped."""
        return self.keep(self.each(self.split(self.text(x), r"\r?\n"), "v", self.strip("v")), "v", "v <> ''")

    def position(self, x: str, v: str) -> str:
        """The place of the first equal element, 0 without one."""
        return f"array_position({x}, {v})"

    def distinct_by(self, x: str, v: str, key: str) -> str:
        """The first element of each value of a key, in order; x is a column."""
        keys = self.each(x, v, key)
        return self.each(self.places(x, "i", f"{self.position(keys, self.at(keys, 'i'))} = i"), "i", self.at(x, "i"))

    def rows(self, x: str) -> str:
        return f"explode({x})"

    def least(self, *xs: str) -> str:
        return f"least({', '.join(xs)})"

    def norm(self, x: str) -> str:
        """The form in which texts are searched."""
        out = self.fold(self._plain(self.text(x)), A.DIGITS)
        out = f"replace({self.sub(out, A.DIACRITICS, '')}, 'ـ', '')"
        return f"lower(trim({self.sub(self.fold(out, A.FOLDED), A.NOT_SEARCHED, ' ')}))"

    def _plain(self, x: str) -> str:
        out = f"translate({x}, {self._quoted(A.COMPAT[0])}, {self._quoted(A.COMPAT[1])})"
        for glyph, whole in A.COMPAT[2]:
            out = f"replace({out}, '{glyph}', '{whole}')"
        return out

    def _quoted(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def sorted(self, x: str) -> str:
        """Each value once, in order of the characters."""
        return f"array_sort(array_distinct({x}))"

    def bound(self, x: str, v: str, body: str) -> str:
        """A body over a value that is computed once, whatever its size."""
        return self.at(self.each(self.list(x), v, body), 1)

    def listed(self, norm: str) -> str:
        """Search tokens of a normalised text in order, each with its variants; repeats stay."""
        number = lambda t: self.match(t, "^[0-9]+$")
        kept = self.keep(self.all(norm, A.TOKEN), "t", f"NOT {self.inside(self.words(A.STOP_WORDS), 't')} AND ({number('t')} OR length(t) > 1)")
        forms = self.list(
            "t",
            "CASE WHEN t LIKE 'ال%' AND length(t) > 3 THEN substring(t, 3) END",
            "CASE WHEN t LIKE 'و%' AND length(t) > 3 THEN substring(t, 2) END",
            "CASE WHEN t LIKE 'وال%' AND length(t) > 4 THEN substring(t, 4) END",
            f"CASE WHEN {number('t')} AND length(t) > 1 THEN reverse(t) END",
        )
        variants = self.keep(forms, "v", f"v IS NOT NULL AND NOT {self.inside(self.words(A.STOP_WORDS), 'v')}")
        return f"flatten({self.each(kept, 't', self.sorted(variants))})"

    def tokens(self, norm: str) -> str:
        """Different search tokens."""
        return self.unique(self.listed(norm))


class Duck(Dialect):
    duck = True

    def s(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    _quoted = s

    def list(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def table(self, name: str) -> str:
        return name

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.s(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(by)}, 'g')"

    def whole(self, x: str, pattern: str) -> str:
        # this engine looks neither back nor ahead and bounds ASCII words only: letters of other scripts get one between them and the match
        other = r"[\x{00C0}-\x{024F}\x{0620}-\x{065F}\x{066E}-\x{06D3}\x{06FA}-\x{06FF}]"
        guarded = self.sub(self.sub(x, rf"({other})([0-9A-Za-z_])", r"\1x\2"), rf"([0-9A-Za-z_])({other})", r"\1x\2")
        return self.all(guarded, rf"\b({pattern})\b", 1)

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.s(pattern)})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, {self.s(path)})"

    def valid(self, x: str) -> str:
        return f"json_valid({x})"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def at(self, x: str, i: int | str) -> str:
        return f"list_extract({x}, {i})"

    def each(self, x: str, v: str, body: str) -> str:
        return f"list_transform({x}, lambda {v}: {body})"

    def keep(self, x: str, v: str, condition: str) -> str:
        return f"list_filter({x}, lambda {v}: {condition})"

    def some(self, x: str, v: str, condition: str) -> str:
        return f"(len({self.keep(x, v, condition)}) > 0)"

    def join(self, x: str, by: str) -> str:
        return f"coalesce(array_to_string({x}, {by if by.startswith('chr(') else self.s(by)}), '')"

    def sorted(self, x: str) -> str:
        return f"list_sort(list_distinct({x}))"

    def unique(self, x: str) -> str:
        # list_distinct loses the order; the list is bound once, as the only element of a list
        return f"list_transform([{x}], lambda l: list_filter(l, lambda e, i: list_position(l, e) = i))[1]"

    def both(self, x: str, y: str) -> str:
        return f"list_intersect({x}, {y})"

    def concat(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def slice(self, x: str, start: int | str, n: int | str) -> str:
        return f"list_slice({x}, {start}, {start} + {n} - 1)"

    def inside(self, x: str, v: str) -> str:
        return f"list_contains({x}, {v})"

    def places(self, x: str, i: str, condition: str) -> str:
        return f"list_filter(range(1, len({x}) + 1), lambda {i}: {condition})"

    def position(self, x: str, v: str) -> str:
        return f"coalesce(list_position({x}, {v}), 0)"

    def rows(self, x: str) -> str:
        return f"unnest({x})"


SPARK, DUCK = Dialect(), Duck()


def column(operator: Callable[..., str], *names: str) -> Column:
    """A Spark column of an operator over named columns."""
    return F.expr(operator(SPARK, *[f"`{n}`" for n in names]))


def query(statement: Callable[[Dialect], str], *tables: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A registered query and its check: the statement run by Spark on the named tables, and its DuckDB text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        for name in tables:
            # columns that the statement doesn't name are pruned before the rows are dealt
            spread(table(spark, folder, name)).createOrReplaceTempView(SPARK.table(name))
        return spark.sql(statement(SPARK))

    run.__doc__ = statement.__doc__
    run.__name__ = statement.__name__
    return run, statement(DUCK)
