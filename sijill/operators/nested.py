"""Problem 3: deeply nested records as related flat tables.

A tree automaton reads each payload once. Going down, its states say what an object
is (root, decision, section, legal_item, reference, entity) by the key it stands
under; coming up, each object gets a shape state from its keys and the states of
their values, the structural variant. All variants share a supertype row (key, table,
path, parent path, subtype, variant, body); each variant goes to the typed table of its
subtype.
"""

from __future__ import annotations

import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sijill.session import texts

# Which child table an element belongs to, by the key it stands under.
CHILD_TABLE = {
    "sections": "section",
    "subsections": "section",
    "legal_items": "legal_item",
    "numbered_items": "legal_item",
    "sub_items": "legal_item",
    "references": "reference",
    "entities": "entity",
    "legal_entities": "entity",
}
#: States in which an object's keys are searched for children.
SEARCHED = {"root", "decision", "section", "legal_item"}
#: Typed subtypes of each child table: name, the keys a variant must have, and the columns; the first that fits takes it.
SUBTYPES = {
    "section": [
        ("section_placed", {"paragraph_indexes"}, {"section_id": "string", "title": "string", "text": "string", "paragraph_indexes": "array<int>"}),
        ("section_plain", set(), {"section_id": "string", "title": "string", "text": "string"}),
    ],
    "legal_item": [
        ("item_placed", {"kind", "paragraph_index"}, {"kind": "string", "number": "string", "paragraph_index": "int", "text": "string"}),
        ("item_kinded", {"kind"}, {"kind": "string", "number": "string", "text": "string"}),
        ("item_numbered", {"number"}, {"number": "string", "paragraph_index": "int", "text": "string"}),
        ("item_plain", set(), {"text": "string"}),
    ],
    "reference": [
        ("reference_targeted", {"target"}, {"type": "string", "text": "string", "target": "string"}),
        ("reference_typed", {"type"}, {"type": "string", "text": "string"}),
        ("reference_plain", set(), {"text": "string"}),
    ],
    "entity": [
        ("entity_party", {"role"}, {"name": "string", "role": "string", "aliases": "array<string>"}),
        ("entity_member", {"category"}, {"name": "string", "category": "string", "aliases": "array<string>"}),
        ("entity_plain", set(), {"name": "string", "aliases": "array<string>"}),
    ],
}
SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("child_table", "path", "parent_path", "subtype", "variant", "body")])
_CONSTANTS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_LITERAL = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\d.])|-?Infinity|NaN|true|false|null")
_BLANKS = re.compile(r"[ \t\n\r]*")


def parsed(text: str):
    """JSON of any depth; ValueError where it isn't complete."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parsed_deep(text)


def _parsed_deep(text: str):
    """What json.loads gives, with the open containers on a stack of their own."""
    at, holder = _BLANKS.match(text, 0).end(), []
    open_: list[tuple] = [(holder, None)]  # container and the key that waits for its value
    while True:
        box, key = open_[-1]
        ch = text[at : at + 1]
        if ch in ("{", "["):
            value, at = ({} if ch == "{" else []), at + 1
        elif ch == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _LITERAL.match(text, at):
            raw, at = m[0], m.end()
            value = _CONSTANTS[raw] if raw in _CONSTANTS else float(raw) if any(c in raw for c in ".eE") else int(raw)
        else:
            raise ValueError(f"no value at {at}")
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        if ch and ch in "{[":
            open_.append((value, None))
            at = _BLANKS.match(text, at).end()
            if ch == "[" and text[at : at + 1] != "]":
                continue
        # what follows a value: an end, the next element, or the next key
        while True:
            at = _BLANKS.match(text, at).end()
            box, _ = open_[-1]
            if len(open_) == 1:
                if at != len(text):
                    raise ValueError(f"more after the value at {at}")
                return holder[0]
            ch = text[at : at + 1]
            if ch == ("}" if isinstance(box, dict) else "]"):
                open_.pop()
                at += 1
                continue
            if ch == ",":
                if not box:
                    raise ValueError(f"no value before the comma at {at}")
                at = _BLANKS.match(text, at + 1).end()
            elif box:
                raise ValueError(f"no comma at {at}")
            break
        if isinstance(box, dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = json.decoder.scanstring(text, at + 1, True)
            at = _BLANKS.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _BLANKS.match(text, at + 1).end()
            open_[-1] = (box, key)


def dumped(value) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out: list[str] = []
        todo: list = [value]
        mark = object()
        while todo:
            v = todo.pop()
            if isinstance(v, tuple) and v[0] is mark:
                out.append(v[1])
            elif isinstance(v, (dict, list)):
                items = list(v.items()) if isinstance(v, dict) else v
                todo.append((mark, "}" if isinstance(v, dict) else "]"))
                for k in range(len(items) - 1, -1, -1):
                    todo.append(items[k][1] if isinstance(v, dict) else items[k])
                    lead = ", " if k else ""
                    todo.append((mark, lead + (json.dumps(items[k][0], ensure_ascii=False) + ": " if isinstance(v, dict) else "")))
                out.append("{" if isinstance(v, dict) else "[")
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


def decoded(value, opening: str = "[{"):
    """Text that is itself JSON (an array, an object or null) as the value it encodes, however often it is wrapped."""
    while isinstance(value, str):
        text = value.strip().lstrip("\ufeff").strip()
        if not text or (text[0] not in opening and text[0] != '"' and text != "null"):
            break
        try:
            value = parsed(text)
        except ValueError:
            break
    return value


class TreeAutomaton:
    """Runs over one parsed payload and collects its supertype rows.

    Transitions are total: a key that isn't in CHILD_TABLE leads to a state that is
    not searched, a scalar to a leaf state. Both directions keep their own stacks, so
    payloads may nest to any depth. An element's state going up is its variant, and its
    table and variant together decide its subtype. Its body holds what is its own:
    children are rows themselves, linked by their parent's path. With `bodies` False the
    body isn't written out.
    """

    def __init__(self, bodies: bool = True):
        self.bodies = bodies
        self.rows: list[tuple] = []
        self.states: dict[int, str] = {}
        self.alive: list[dict] = []

    def shape(self, value) -> str:
        """The bottom-up state: s, n, b, z for scalars; [..] and {..} from the children's states, those of containers by a digest."""
        states = self.states
        if not isinstance(value, (dict, list)):
            return "z" if value is None else "b" if isinstance(value, bool) else "n" if isinstance(value, (int, float)) else "s"
        todo = [value]
        while todo:
            node = todo[-1]
            if id(node) in states:
                todo.pop()
                continue
            inner = node.values() if isinstance(node, dict) else node
            open_ = [v for v in inner if isinstance(v, (dict, list)) and id(v) not in states]
            if open_:
                todo += open_
                continue
            if isinstance(node, dict):
                states[id(node)] = "{" + ",".join(sorted([f"{k}:{self._child(v)}" for k, v in node.items()])) + "}"
            else:
                states[id(node)] = "[" + "|".join(sorted({self._child(v) for v in node})) + "]"
            todo.pop()
        return states[id(value)]

    def _child(self, value) -> str:
        state = self.shape(value) if not isinstance(value, (dict, list)) else self.states[id(value)]
        return state if len(state) <= 16 else f"{state[0]}{zlib.crc32(state.encode()):08x}{state[-1]}"

    def run(self, payload: str | None) -> list[tuple]:
        """Rows of one payload; none where it is absent or not complete JSON."""
        self.rows, self.states, self.alive = [], {}, []
        if payload is None:
            return self.rows
        try:
            value = decoded(parsed(payload.lstrip("\ufeff")))
        except ValueError:
            return self.rows
        if isinstance(value, dict):
            self._search(value, "", "", "root")
        return self.rows

    def _search(self, node: dict, at: str, parent: str, state: str) -> None:
        stack = [(node, at, parent, state)]
        while stack:
            node, at, parent, state = stack.pop()
            for key, value in node.items():
                here = f"{at}.{key}" if at else key
                if key == "decision" and state == "root":
                    value = decoded(value)
                    if isinstance(value, dict):
                        stack.append((value, here, parent, "decision"))
                    continue
                table = CHILD_TABLE.get(key)
                if table is None:
                    continue
                value = decoded(value)
                if table == "entity" and isinstance(value, dict) and not self._is_entity(value):
                    for category, members in value.items():
                        self._elements(decoded(members), f"{here}.{category}", parent, table, stack)
                else:
                    self._elements(value, here, parent, table, stack)

    @staticmethod
    def _is_entity(value: dict) -> bool:
        """A lone entity standing in place of a list: it has a name that is plain text."""
        return isinstance(value.get("name"), str) and isinstance(decoded(value["name"]), str)

    @staticmethod
    def subtype(table: str, element) -> str:
        """The first subtype of the table whose keys the element's state has."""
        keys = element.keys() if isinstance(element, dict) else ()
        return next(name for name, needed, _ in SUBTYPES[table] if needed <= set(keys))

    def _elements(self, value, here: str, parent: str, table: str, stack: list) -> None:
        if value is None:
            return
        for i, element in enumerate(value if isinstance(value, list) else [value]):
            element = decoded(element, "{")
            if isinstance(element, dict):
                self.alive.append(element)  # states go by identity
            if not isinstance(element, (dict, str)):
                continue
            path = f"{here}[{i}]"
            body = None
            if self.bodies:
                own = {k: v for k, v in element.items() if k not in CHILD_TABLE} if isinstance(element, dict) and table in SEARCHED else element
                body = dumped(own)
            self.rows.append((table, path, parent, self.subtype(table, element), self.shape(element), body))
            if isinstance(element, dict) and table in SEARCHED:
                stack.append((element, path, path, table))


def nested_rows(df: DataFrame, key: str, payload: str, bodies: bool = True) -> DataFrame:
    """The supertype table: key, child_table, path, parent_path, subtype, variant, body.

    Null, cut-off and non-object payloads give no rows; repeated records give theirs
    each; other columns are not read. Streams batches, so a partition's size is the
    only bound on memory; no shuffle.
    """
    kind = df.schema[key].dataType

    def run(batches):
        automaton = TreeAutomaton(bodies)
        to_key = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend((k, *row) for row in automaton.run(text))
                if len(out) >= 20_000:
                    yield _batch(out, to_key)
                    out = []
            if out:
                yield _batch(out, to_key)

    def _batch(out, to_key):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], to_key)] + [pa.array(c, pa.string()) for c in cols[1:]], [key, *SCHEMA.names])

    return df.select(key, payload).where(F.col(payload).isNotNull()).mapInArrow(run, T.StructType([T.StructField(key, kind), *SCHEMA.fields]))


def subtype_table(rows: DataFrame, subtype: str) -> DataFrame:
    """One typed table: the common supertype keys and parent links, then the subtype's columns.

    A plain-text element fills the column that carries its text; a reference's target is
    kept as JSON. A value of another type than its column's reads as null there and stays
    in the supertype's body.
    """
    fields = next(columns for options in SUBTYPES.values() for name, _, columns in options if name == subtype)
    return _typed(rows.where(F.col("subtype") == subtype), fields)


def child_rows(rows: DataFrame, child_table: str) -> DataFrame:
    """All subtypes of a child table under their common columns."""
    fields = {k: v for _, _, columns in SUBTYPES[child_table] for k, v in columns.items()}
    return _typed(rows.where(F.col("child_table") == child_table), fields)


def _typed(own: DataFrame, fields: dict[str, str]) -> DataFrame:
    lead = "name" if "name" in fields else "text"
    keys = [c for c in own.columns if c not in ("body", "child_table")]
    own = own.withColumn("_p", F.from_json("body", ", ".join(f"{k} {v}" for k, v in fields.items())))
    plain = F.when(F.col("variant") == "s", F.from_json(F.concat(F.lit('{"v":'), F.col("body"), F.lit("}")), "v string")["v"])
    return own.select(*keys, *[(F.coalesce(plain, F.col("_p")[k]) if k == lead else F.col("_p")[k]).alias(k) for k in fields])


def variant_table(rows: DataFrame) -> DataFrame:
    """How often each structural variant occurs in each subtype."""
    return rows.groupBy("child_table", "subtype", "variant").agg(F.count(F.lit(1)).alias("n_rows"))


def _rows(spark: SparkSession, folder: str, bodies: bool = True) -> DataFrame:
    return nested_rows(texts(spark, folder, "loaded_legal_json", "record_id", "payload"), "record_id", "payload", bodies)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every element that the automaton classified and routed to a subtype; bodies aren't written out for links alone."""
    return _rows(spark, folder, bodies=False).where(F.col("subtype").isNotNull() & F.col("variant").isNotNull()).select("record_id", "child_table", "path", "parent_path")


def p3_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variant_table(_rows(spark, folder, bodies=False))


def p3_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each typed table; they add up to those of p3_found."""
    return _rows(spark, folder, bodies=False).groupBy("child_table", "subtype").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_sections(spark: SparkSession, folder: str) -> DataFrame:
    return child_rows(_rows(spark, folder), "section")


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    return child_rows(_rows(spark, folder), "entity")


def p3_legal_items(spark: SparkSession, folder: str) -> DataFrame:
    return child_rows(_rows(spark, folder), "legal_item")


def p3_references(spark: SparkSession, folder: str) -> DataFrame:
    return child_rows(_rows(spark, folder), "reference")
