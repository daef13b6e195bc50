"""Problem 5: text garbled by a wrong decoding.

A hidden Markov model labels every character with the clean state or with one state
per encoding pair (the true encoding, the one it was read as). Emissions look at a
character and its neighbours: inside a pair's state, characters that form valid bytes
of the true encoding are expected; in the clean state, runs of symbols and accented
letters are not. Each labelled span gets the inverse transform of its state, and the
model runs again on the result, which undoes text garbled more than once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import texts

# The encoding pairs (true encoding, read as), one state each.
PAIRS = [
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1256"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "cp1251"),
    ("cp1256", "cp1252"),
]
#: Log-scores. A switch into a garbled state and out of it; what a character costs.
ENTER, LEAVE, OFF, ORPHAN, SINGLE = -5.0, -0.5, -9.0, -3.0, -0.3
ALONE, PACKED, CONTROL, LOST, COINCIDENCE = -1.5, -5.0, -6.0, -5.0, -2.5
_CELLS = 1_500_000


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> np.ndarray:
    """For each BMP code point its byte in a single-byte encoding, -1 without; undefined bytes stand for themselves."""
    out = np.full(65536, -1, np.int16)
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        if out[ord(ch)] < 0:
            out[ord(ch)] = b
    return out


@lru_cache(maxsize=None)
def _chars_of(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=None)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether garbling leaves such characters; whether beside another they speak for it; the cost of one alone in clean text."""
    odd, alone = np.zeros(65536, bool), np.zeros(65536, np.float32)
    for _, read in PAIRS:
        if read not in ("cp1256", "cp1251"):
            odd |= _bytes_of(read) >= 0x80
    odd[:128] = False
    cp1256 = _bytes_of("cp1256")
    arabic = np.zeros(65536, bool)
    arabic[0x600:0x700] = True
    odd |= (cp1256 >= 0x80) & ~arabic
    odd[0x200C:0x2010] = False  # joiners and direction marks are clean
    odd[0x3A0:0x3C0] = False
    odd[[0xA0, 0xAD]] = False  # blanks and soft hyphens stand beside anything
    alone[odd] = -3.0
    alone[0xC0:0x180] = ALONE
    strong = odd.copy()
    for cp in (*range(0x2010, 0x2015), *range(0x2018, 0x201E), 0x2022, 0x2026, 0xA0, 0xAB, 0xBB, 0xAD, 0xB7, 0xB0, 0x3BC, 0x3C0, 0x3A9):
        alone[cp] = 0.0
        strong[cp] = False  # ordinary marks, also beside each other
    alone[0x80:0xA0] = CONTROL
    alone[0xFFFD] = LOST
    odd[0xFFFD] = strong[0xFFFD] = True
    return odd, strong, alone


#: A character that plain Arabic or ASCII text doesn't have; one cheap scan settles most values.
UNUSUAL = r"[^\x{9}-\x{D}\x{20}-\x{7E}\x{60C}-\x{652}\x{660}-\x{669}]"
_ODD = r"\x{80}-\x{9F}\x{A1}-\x{AC}\x{AE}-\x{17E}\x{192}\x{2C6}-\x{2DD}\x{3A3}-\x{3C6}\x{2010}-\x{203A}\x{207F}\x{20A7}\x{20AC}\x{2116}-\x{2126}\x{2202}-\x{25CA}\x{F8FF}-\x{FB02}"
#: Two odd neighbours, a control, a lost character, or bytes of UTF-8 read as cp1256 or cp1251.
SUSPICIOUS = rf"[{_ODD}][{_ODD} \x{{A0}}\x{{AD}}?]|[\x{{80}}-\x{{9F}}\x{{FFFD}}]|[طظ][\x{{A1}}-\x{{BF}}\x{{152}}-\x{{192}}\x{{2C6}}\x{{60C}}-\x{{61F}}\x{{679}}-\x{{6BE}}\x{{200C}}-\x{{2122}}]|[РСШЩ][\x{{402}}-\x{{45F}}\x{{A0}}-\x{{BB}}\x{{2013}}-\x{{203A}}]"


def suspicious(col: Column) -> Column:
    """Whether a value needs the model at all; decided in the JVM, by two patterns of growing cost."""
    return col.rlike(UNUSUAL) & col.rlike(SUSPICIOUS)


def _members(cp: np.ndarray, read: str) -> tuple[np.ndarray, np.ndarray]:
    """Where characters are bytes of a valid UTF-8 sequence; where they are its bytes at all (flattened rows padded with 0)."""
    b = _bytes_of(read)[cp]
    cont = (b >= 0x80) & (b < 0xC0)
    c1, c2, c3 = (np.zeros_like(cont) for _ in range(3))
    c1[:, :-1], c2[:, :-2], c3[:, :-3] = cont[:, 1:], cont[:, 2:], cont[:, 3:]
    # leads of the scripts written here: Latin, modifiers, Greek, Cyrillic, Arabic; punctuation, presentation forms, emoji
    scripts = np.isin(b, (*range(0xC2, 0xC7), 0xCB, *range(0xCE, 0xD2), *range(0xD8, 0xDC)))
    two, three, four = scripts & c1, ((b == 0xE2) | (b == 0xEF)) & c1 & c2, (b == 0xF0) & c1 & c2 & c3
    lead = two | three | four
    out = lead.copy()
    out[:, 1:] |= lead[:, :-1]
    out[:, 2:] |= (three | four)[:, :-2]
    out[:, 3:] |= four[:, :-3]
    return out, b >= 0x80


def _scores(cp: np.ndarray) -> np.ndarray:
    """Emission log-scores [state, row, position]."""
    odd, strong, alone = _classes()
    rows, length = cp.shape
    plain = cp < 128
    is_odd, is_strong = odd[cp], strong[cp]
    beside = np.zeros_like(is_odd)
    beside[:, 1:] |= is_strong[:, :-1]
    beside[:, :-1] |= is_strong[:, 1:]
    out = np.empty((len(PAIRS) + 1, rows, length), np.float32)
    clean = alone[cp]
    clean[is_odd & beside] = np.minimum(clean[is_odd & beside], PACKED)
    for s, (true, read) in enumerate(PAIRS, 1):
        if true == "utf-8":
            member, byte = _members(cp, read)
            score = np.where(plain | member, 0.0, np.where(byte | (cp == 0xFFFD), ORPHAN if read not in ("cp1256", "cp1251") else OFF, OFF))
            # bytes that fit together are seldom there by chance
            clean = np.where(member, np.minimum(clean, COINCIDENCE), clean)
        else:
            b = _bytes_of(read)[cp]
            back = np.array([ord(c) if 0x600 <= ord(c) < 0x700 else 0 for c in _chars_of(true)] + [0])[np.where(b < 0, 256, b)]
            score = np.where(plain, 0.0, np.where((back > 0) & (b >= 0x80), SINGLE, OFF))
        out[s] = score
    out[0] = clean
    return out


def _viterbi(cp: np.ndarray) -> np.ndarray:
    """The likeliest states [row, position]; all rows advance together."""
    emit = _scores(cp)
    states, rows, length = emit.shape
    back = np.empty((length, states, rows), np.uint8)
    best = np.full((states, rows), ENTER, np.float32)
    best[0] = 0
    best += emit[:, :, 0]
    own = np.arange(states, dtype=np.uint8)[:, None]
    for t in range(1, length):
        # from a garbled state back to the clean one, from the clean one into any other
        garbled = best[1:].argmax(0)
        left = best[1:].max(0) + LEAVE
        entered = best[0] + ENTER
        step = np.broadcast_to(own, (states, rows)).copy()
        moved = entered[None] > best[1:]
        step[1:][moved] = 0
        out = left > best[0]
        step[0][out] = (garbled + 1)[out]
        best[1:] = np.maximum(best[1:], entered[None])
        best[0] = np.where(out, left, best[0])
        back[t] = step
        best += emit[:, :, t]
    labels = np.empty((rows, length), np.uint8)
    at = best.argmax(0)
    every = np.arange(rows)
    for t in range(length - 1, -1, -1):
        labels[:, t] = at
        if t:
            at = back[t, at, every]
    return labels


def _codes(texts: list[str]) -> np.ndarray:
    width = max(map(len, texts))
    out = np.zeros((len(texts), width), np.int64)
    for i, text in enumerate(texts):
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(a)] = np.where(a < 65536, a, 0xFFFE)
    return out


def _inverse(span: str, pair: tuple[str, str]) -> str | None:
    """The span's true text; None where bytes were lost. Plain ASCII stands for itself."""
    true, read = pair
    codes = _bytes_of(read)
    raw = bytearray()
    for ch in span:
        b = int(codes[ord(ch)]) if ord(ch) < 65536 else -1
        if b < 0:
            return None
        raw.append(b)
    if true == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    chars = _chars_of(true)
    return "".join(chars[b] for b in raw)


def restore_all(texts: list[str]) -> list[tuple[bool, str | None]]:
    """For each text: whether it is garbled, and its restored form, None where bytes were lost."""
    state: list[list] = [[False, t] for t in texts]
    todo = [i for i, t in enumerate(texts) if t]
    # text garbled several times goes through the model until nothing changes or an earlier form returns
    seen: list[set[str]] = [{t} if t else set() for t in texts]
    while todo:
        todo.sort(key=lambda i: len(state[i][1]))
        again, k = [], 0
        while k < len(todo):
            n = max(1, min(len(todo) - k, 1024))
            while n > 1 and n * len(state[todo[k + n - 1]][1]) * (len(PAIRS) + 1) > _CELLS * 4:
                n //= 2
            part, k = todo[k : k + n], k + n
            labels = _viterbi(_codes([state[i][1] for i in part]))
            for row, i in enumerate(part):
                text = state[i][1]
                own = labels[row, : len(text)]
                if not own.any():
                    continue
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(text)]
                out, lost = [], False
                for a, b in zip(cuts, cuts[1:]):
                    piece = text[a:b]
                    if own[a]:
                        piece = _inverse(piece, PAIRS[own[a] - 1])
                        if piece is None:
                            lost = True
                            break
                    out.append(piece)
                new = None if lost else "".join(out)
                if new == text:
                    continue
                state[i] = [True, new]
                if new and new not in seen[i]:
                    seen[i].add(new)
                    again.append(i)
        todo = again
    return [(g, t) for g, t in state]


def _restored(batches):
    for batch in batches:
        keys, values = batch.column(0), batch.column(1).to_pylist()
        found = restore_all([v or "" for v in values])
        keep = [i for i, (g, _) in enumerate(found) if g]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(keep, pa.int64())), pa.array([found[i][1] for i in keep], pa.string())], ["row_key", "restored"])


def garbled_values(df: DataFrame, key: str, field: str, name: str) -> DataFrame:
    """(table_name, field, row_key, restored) of the garbled values of one field.

    `restored` is null where bytes were lost. Null and empty values are never garbled,
    repeated rows are reported each, other columns are not read. Only values that the
    JVM-side pattern lets through reach Python; a clean value costs one scan of its text.
    """
    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(field).alias("_v")).where(suspicious(F.col("_v")))
    # the suspicious values are few and lie unevenly in the files: dealt anew by key
    out = rows.repartition(F.expr("row_key")).mapInArrow(_restored, "row_key long, restored string")
    return out.select(F.lit(name).alias("table_name"), F.lit(field).alias("field"), "row_key", "restored")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        garbled_values(texts(spark, folder, "loaded_legal_json", "record_id", "long_text"), "record_id", "long_text", "loaded_legal_json"),
        garbled_values(texts(spark, folder, "chunks", "row_id", "text"), "row_id", "text", "chunks"),
        garbled_values(texts(spark, folder, "search_records", "search_id", "title"), "search_id", "title", "search_records"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_restored(spark, folder).select("table_name", "field", "row_key", F.coalesce(F.md5(F.col("restored").cast("binary")), F.lit("")).alias("restored_md5"))
