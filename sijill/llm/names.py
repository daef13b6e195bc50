"""Problem 4: variant spellings of names typed by people.

Typed values are reduced to cores (titles, forms of address, offices and generic words
taken off); registered parties get the forms people write them in. Both lie in a metric
space under the edit distance. Forms are assigned to their nearest pivot; a core goes to
every cell whose forms can lie within its radius by the triangle inequality, and inside
each cell an exact radius join finds the forms. A core means a party if that party alone
is nearest and its words agree one by one.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import materialize, table

#: The largest radius, and the cores that a cell gives one task; larger cells are dealt over salts.
RADIUS, SHARE = 3, 5_000
#: Pivots of a kind: the root of its number of forms, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 16, 255
#: Forms from which pivots are drawn; a bound for the draw only, every form is placed.
PIVOT_SAMPLE = 4_000

# Words of address and rank, offices, and the generic words of each kind of organisation.
ADDRESS = "السيد السيده الساده سياده معالي سعاده فخامه حضره الاستاذ الاستاذه الدكتور الدكتوره المهندس المهندسه الحاج الشيخ القاضي اللواء العميد الي المحترم المحترمون المحترمين المحترمه د م ا أ".split()
COURTESY = "المحترم المحترمون المحترمين المحترمه".split()
OFFICES = "مكتب قسم شعبه وحده امانه سكرتاريه".split()
MINISTRY, DIRECTORATE, COMPANY = ["وزاره"], ["المديريه", "مديريه", "دائره"], ["شركه"]
#: Letters that carry no root consonant inside a first name (after folding), and what ends a pet form.
WEAK, PET_ENDS = "اوي", ("", "ي", "ه")
_FOLD = str.maketrans("أإآٱىةیکؤئ", "ااااىهيكوي".replace("ى", "ي"), "ـ")


def fold(text: str) -> str:
    """One form of letters, without marks, stretching and punctuation but `/`, `-` and `.`."""
    text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    text = "".join(ch for ch in text if unicodedata.category(ch) not in ("Mn", "Cf"))
    text = re.sub(r"[–—‐‑−]", "-", text)
    text = re.sub(r"[^\w\s/.\-]", " ", text)
    return re.sub(r"\s+", " ", text).strip().lower()


def osa(a: str, b: str, most: int = 3) -> int:
    """Edits with swaps of neighbours between two words, for the check of single words."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def _near(word: str, generic: list[str]) -> int | None:
    """Edits to the nearest of some generic words, None where too far."""
    best = min((osa(word, g) for g in generic), default=9)
    return best if best <= (2 if len(word) > 3 else 0) else None


def _parts(text: str) -> list[str]:
    """A name's words, with `-` and lone `و` between names joined to the next word."""
    text = re.sub(r"\s*-\s*", " ", text.replace("/", " "))
    text = re.sub(r"(?<=\S)\s+و\s+(?=\S)", " و", text)
    return text.replace(".", " ").split()


def cores(value: str) -> list[tuple[str, str, int]]:
    """(kind, core, edits already spent) of the readings of one typed value."""
    text = fold(value)
    # offices stand behind or before a slash; `الى/` leads
    pieces = [p.strip() for p in re.split(r"\s*/\s*", text)]
    kept = [p for i, p in enumerate(pieces) if p and not ((words := p.split()) and i > 0 and _near(words[0], OFFICES) in (0, 1) and len(words) <= 3)]
    text = " / ".join(kept)
    words = text.replace(".", ". ").split()
    initial = ""
    while words and (words[0].rstrip(".") in ADDRESS and not (words[0] in ("م.", "م") and len(words) > 1 and words[1] in ("ع.", "ع")) or words[0] in ("/", "-")):
        # `م.` may be an engineer or the initial of a first name
        initial = words.pop(0).rstrip(".")
    while words and (words[-1] in COURTESY or words[-1] == "/" or len(words[-1]) > 5 and osa(words[-1], "المحترمون") <= 2):
        words.pop()
    if not words:
        return []
    out: list[tuple[str, str, int]] = []
    text = " ".join(words)
    bare = [w for w in _parts(text) if w not in ("في", "فى")]
    if not bare:
        return []
    limited = re.sub(r"\s*(?:م\s*\.\s*م\.?|م م|المحدوده|محدوده)\s*$", "", text)
    # ministries
    if words[0] in ("و.", "و") and len(words) > 1:
        out.append(("ministry", " ".join(_parts(" ".join(words[1:]))), 0))
    elif (e := _near(bare[0], MINISTRY)) is not None and len(bare) > 1:
        out.append(("ministry", " ".join(bare[1:]), e))
    # directorates
    if len(words) > 2 and words[0].rstrip(".") == "م" and words[1].rstrip(".") == "ع":
        out.append(("directorate", " ".join(bare[2:]), 0))
    elif (e := _near(bare[0], DIRECTORATE)) is not None and len(bare) > 1:
        rest = bare[1:]
        if (g := _near(rest[0], ["العامه"])) is not None and len(rest) > 1:
            out.append(("directorate", " ".join(rest[1:]), e + g))
        else:
            out.append(("directorate", " ".join(rest), e))
    # companies
    named = limited != text
    lead = _parts(limited)
    if lead and (words[0] in ("ش.", "ش")) and len(lead) > 1:
        out.append(("company", " ".join(lead[1:]), 0))
    elif lead and (e := _near(lead[0], COMPANY)) is not None and len(lead) > 1:
        out.append(("company", " ".join(_drop_limited(lead[1:])), e))
    elif named and lead:
        out.append(("company", " ".join(lead), 0))
    person = [w for w in bare if w not in ("بن", "بنت", "ابن")]
    if len(initial) == 1:
        out.append(("person", " ".join([initial, *person]), 0))
    if len(bare[0]) == 1:
        out.append(("person", " ".join(person), 0))
    if not any(e == 0 and k != "person" for k, _, e in out):
        out.append(("company", " ".join(_drop_limited(lead)), 0))
        out.append(("directorate", " ".join(bare), 0))
        out.append(("person", " ".join(person), 0))
    return [(k, c, e) for k, c, e in dict.fromkeys(out) if len(c) > 1]  # a single letter names nobody


def _drop_limited(words: list[str]) -> list[str]:
    return words[:-1] if len(words) > 2 and osa(words[-1], "المحدوده") <= 2 else words


def pet_forms(first: str) -> set[str]:
    """The usual short forms of a first name, by rule.

    Its root consonants take a long u before the last one and a familiar ending (salim:
    sallum, sallumi), two consonants are doubled (zina: zanzuna), the first two take
    long vowels (marwan: maru), four letters are broken up (kawthar: kawathir), or the stem
    takes the ending of belonging (shadha: shadhawi).
    A name with `abd` goes by what follows it.
    """
    name = first.removeprefix("عبد ").removeprefix("ال") if first.startswith("عبد ") else first
    if len(name) < 3 or " " in name:
        return set()
    out: set[str] = set()
    stem = name.rstrip("هي") if len(name.rstrip("هي")) > 1 else name
    inner = "".join(ch for ch in name[1:].removesuffix("ه") if ch not in WEAK and ch != "ء")
    hard = {name[0] + inner, inner if name[0] in WEAK else name[0] + inner}
    # the root as it stands, and the name with its vowels where none is right before the last letter
    for root in {r for r in hard if len(r) > 1} | ({name} if len(name) > 3 and name[-2] not in WEAK and name[-1] not in WEAK + "ه" else set()):
        out |= {root[:-1] + "و" + root[-1] + end for end in PET_ENDS}
        if len(root) == 2:
            out |= {root + root[0] + "و" + root[1] + end for end in PET_ENDS} | {f"{root[0]}و{root[1]}{end}" for end in PET_ENDS}
    # a root that ends in a vowel or glottal stop keeps its glide
    glide = name.rstrip("اءه")
    if glide != name and glide[-1] == "ي":
        out |= {glide + "وي", glide + "و"}
    if len(inner) > 0:
        out.add(name[0] + "ا" + inner[0] + "و")
    if len(name) == 4 and name[1] == "و":
        out.add(name[:2] + "ا" + name[2:])
    out.add(stem + "اوي")
    return {f for f in out if len(f) > 2}


def forms(name: str, kind: str) -> list[tuple[str, str]]:
    """(kind, form): how a registered name may be written, as cores."""
    text = fold(name)
    words = text.split()
    out: set[tuple[str, str]] = set()
    if kind == "person":
        # a first name of two words stays whole
        n = 2 if words[0] == "عبد" and len(words) > 2 else 1
        first, rest, last = " ".join(words[:n]), words[n:-1], words[-1]
        firsts = {first, first[0]}
        middles = {"", " ".join(rest), " ".join(w[0] for w in rest)}
        if rest:
            middles |= {rest[0], rest[0][0]}
        for f in firsts:
            for m in middles:
                if len(f) == 1 and not m:
                    continue
                for end in {last, last.removeprefix("ال")}:
                    out |= {("person", " ".join(f"{f} {m} {end}".split())), ("person", " ".join(f"{end} {f} {m}".split()))}
        # a pet form goes with the last name, at most with the father's between
        for f in pet_forms(first):
            for m in {"", *rest[:1]}:
                out |= {("person", " ".join(f"{f} {m} {last}".split())), ("person", " ".join(f"{last} {f} {m}".split()))}
    elif words[0] == MINISTRY[0]:
        parts = [w[1:] if i and w.startswith("و") else w for i, w in enumerate(words[1:])]
        out |= {("ministry", p) for p in parts} | {("ministry", p.removeprefix("ال")) for p in parts}
        for order in (parts, parts[::-1]):
            out.add(("ministry", " و".join(order)))
            out.add(("ministry", " ".join(order)))
    elif words[0] in DIRECTORATE:
        rest = words[2:] if words[1:2] == ["العامه"] else words[1:]
        at = rest.index("في") if "في" in rest else len(rest)
        doing, place = " ".join(rest[:at]), " ".join(rest[at + 1 :])
        plain = "ال" + doing[2:] if doing.startswith("لل") else doing.removeprefix("ل")
        for d in {doing, plain, "ل" + plain}:
            out |= {("directorate", f"{d} {place}".strip()), ("directorate", f"{d} ب{place}"), ("directorate", f"{place} {d}".strip())}
    elif words[0] == COMPANY[0]:
        rest = _drop_limited(words[1:])
        at = next((i for i, w in enumerate(rest) if i and w.startswith("ل") and len(w) > 3), len(rest))
        own, doing = " ".join(rest[:at]), " ".join(rest[at:])
        out |= {("company", own), ("company", f"{own} {doing}".strip()), ("company", f"{doing} {own}".strip()), ("company", f"{doing} {words[0]} {own}".strip())}
    else:
        out.add(("company", text))
    return sorted(f for f in out if len(f[1]) > 1)


#: Characters that one machine word holds in the bit-parallel columns.
WORD = 63


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(size.max(initial=1)))), np.uint32)
    for i, t in enumerate(texts):
        out[i, : size[i]] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def edit_distance(a: str, b: str) -> int:
    """Edits between two texts of any length, by bit-parallel columns on one long integer."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    pv, mv = full, 0
    for ch in b:
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += (ph >> top & 1) - (mh >> top & 1)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return score


def distances(a: list[str], b: list[str], ai: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Exact edit distances of the pairs (a[ai], b[bi]), all at once by bit-parallel columns; texts over a machine word one by one."""
    if not len(ai):
        return np.zeros(0, np.int64)
    long_a = np.fromiter((len(t) > WORD for t in a), bool, len(a))
    if long_a.any():
        out = np.empty(len(ai), np.int64)
        wide = long_a[ai]
        for k in np.flatnonzero(wide):
            out[k] = edit_distance(a[ai[k]], b[bi[k]])
        rest = np.flatnonzero(~wide)
        short = [t if len(t) <= WORD else "" for t in a]
        out[rest] = distances(short, b, ai[rest], bi[rest])
        return out
    ca, na = _padded(a)
    cb, nb = _padded(b)
    alphabet, flat = np.unique(np.concatenate([ca.ravel(), cb.ravel()]), return_inverse=True)
    ia, ib = flat[: ca.size].reshape(ca.shape), flat[ca.size :].reshape(cb.shape)
    masks = np.zeros((len(a), len(alphabet)), np.uint64)
    for j in range(ca.shape[1]):
        rows = np.flatnonzero(na > j)
        masks[rows, ia[rows, j]] |= np.uint64(1 << j)
    out = np.empty(len(ai), np.int64)
    one = np.uint64(1)
    for start in range(0, len(ai), 500_000):
        x, y = ai[start : start + 500_000], bi[start : start + 500_000]
        top = (na[x] - 1).clip(0).astype(np.uint64)
        pv, mv = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
        score = na[x].copy()
        result = np.where(nb[y] == 0, score, 0)
        for j in range(cb.shape[1]):
            eq = masks[x, ib[y, j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score = score + ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            result = np.where(nb[y] == j + 1, score, result)
        out[start : start + 500_000] = np.where(na[x] == 0, nb[y], result)
    return out


def radius(core: str) -> int:
    """Edits within which forms are candidates; a swap of neighbours counts as two here. In two or three letters an edit makes another word."""
    return 0 if len(core) < 4 else 2 if len(core) < 13 else RADIUS


def choose_pivots(texts: list[str], k: int) -> list[str]:
    """Far from each other: each next pivot is the text farthest from all before."""
    texts = sorted(set(texts))
    if not texts:
        return []
    pivots, far = [texts[0]], None
    every = np.arange(len(texts))
    while len(pivots) < min(k, len(texts)):
        d = distances([pivots[-1]], texts, np.zeros(len(texts), np.int64), every)
        far = d if far is None else np.minimum(far, d)
        if far.max() == 0:
            break
        pivots.append(texts[int(far.argmax())])
    return pivots


def _to_pivots(texts: list[str], pivots: list[str]) -> np.ndarray:
    n, k = len(texts), len(pivots)
    return distances(texts, pivots, np.repeat(np.arange(n), k), np.tile(np.arange(k), n)).reshape(n, k)


def agrees(core: str, form: str) -> bool:
    """Word by word: initials exactly, short words within one edit, longer ones within two; or as a whole where words run together."""
    a, b = core.split(), form.split()
    if len(a) == len(b):
        return all(x == y if min(len(x), len(y)) == 1 else osa(x, y) <= (1 if max(len(x), len(y)) < 6 else 2) for x, y in zip(a, b))
    return not any(len(w) == 1 for w in b) and osa("".join(a), "".join(b)) <= 2


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def radius_join(typed: DataFrame, registered: DataFrame) -> DataFrame:
    """(kind, core, party_id, form, distance): all pairs of a core and a form of its kind within the core's radius.

    typed: different (kind, core); registered: party_id, kind, form. Exact: with p the
    nearest pivot of a form f, d(q, p) <= d(q, p*) + 2r for the core's own nearest pivot
    p*, and d(q, p) <= r + the cell's radius; all such cells get the core. Inside a cell
    pairs are first bounded by their distances to all pivots. A cell with more than SHARE
    cores is dealt over salts; only such a cell's forms are copied.
    """
    spark = typed.sparkSession
    counted = {r.kind: r.n for r in registered.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = registered.select("kind", "form").distinct().orderBy(F.xxhash64("kind", "form")).limit(PIVOT_SAMPLE).collect()
    k_of = {kind: min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5))) for kind, n in counted.items()}
    pivots = {k: choose_pivots([r.form for r in drawn if r.kind == k], k_of[k]) for k in {r.kind for r in drawn}}
    shared = spark.sparkContext.broadcast(pivots)
    PLACED = pa.schema([("party_id", pa.int64()), ("kind", pa.string()), ("form", pa.string()), ("cell", pa.int32()), ("far", pa.int32()), ("to_pivots", pa.binary())])
    DEALT = pa.schema([("kind", pa.string()), ("core", pa.string()), ("cell", pa.int32()), ("to_pivots", pa.binary())])
    # distances to the pivots as bytes; cut at 255 they still bound distances from below
    packed = lambda d: [row.tobytes() for row in np.minimum(d, 255).astype(np.uint8)]

    def place(batches):
        for b in batches:
            rows = b.to_pylist()
            for kind in {r["kind"] for r in rows} & set(shared.value):
                own = [r for r in rows if r["kind"] == kind]
                d = _to_pivots([r["form"] for r in own], shared.value[kind])
                near = d.argmin(1)
                yield _batch([{"cell": int(c), "far": int(x[c]), "to_pivots": p, **r} for r, x, c, p in zip(own, d, near, packed(d))], PLACED)

    placed = materialize(registered.select("party_id", "kind", "form").mapInArrow(place, "party_id long, kind string, form string, cell int, far int, to_pivots binary"), "name-forms")
    reach = {(r.kind, r.cell): r.far for r in placed.groupBy("kind", "cell").agg(F.max("far").alias("far")).collect()}
    reached = spark.sparkContext.broadcast(reach)

    def deal(batches):
        for b in batches:
            rows = b.to_pylist()
            for kind in {r["kind"] for r in rows} & set(shared.value):
                own = [r for r in rows if r["kind"] == kind]
                d = _to_pivots([r["core"] for r in own], shared.value[kind])
                far = np.array([reached.value.get((kind, c), -(10**6)) for c in range(d.shape[1])])
                r = np.array([radius(x["core"]) for x in own])[:, None]
                hit = (d <= d.min(1, keepdims=True) + 2 * r) & (d <= r + far[None])
                bytes_ = packed(d)
                out = [{**own[i], "cell": int(c), "to_pivots": bytes_[i]} for i, c in zip(*np.nonzero(hit))]
                if out:
                    yield _batch(out, DEALT)

    dealt = materialize(over_cores(typed).mapInArrow(deal, "kind string, core string, cell int, to_pivots binary"), "name-cores-dealt")
    # one number a cell: cells with more cores than a task should have are dealt over salts, and only their forms are copied
    sizes = dealt.groupBy("kind", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    salted = dealt.join(F.broadcast(sizes), ["kind", "cell"]).withColumn("salt", F.pmod(F.xxhash64("core"), F.col("salts")).cast("int")).drop("salts")
    copied = placed.join(F.broadcast(sizes), ["kind", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "far")

    def join(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "core", "party_id", "form", "distance"]
        if not len(q) or not len(f):
            return pd.DataFrame({n: pd.Series([], dtype="int64" if n in ("party_id", "distance") else object) for n in names})
        qs, fs = q["core"].tolist(), f["form"].tolist()
        nf, nq = np.array([len(x) for x in fs]), np.array([len(x) for x in qs])
        far = np.array([radius(x) for x in qs])
        tables = [np.frombuffer(b"".join(x["to_pivots"]), np.uint8).reshape(len(x), -1).astype(np.int16) for x in (q, f)]
        cell = int(q["cell"].iloc[0])
        order = [cell, *(k for k in range(tables[0].shape[1]) if k != cell)]
        out = []
        for start in range(0, len(qs), 500):
            rows = slice(start, start + 500)
            r = far[rows]
            qi, fi = np.nonzero((abs(tables[0][rows, cell][:, None] - tables[1][:, cell][None]) <= r[:, None]) & (abs(nq[rows][:, None] - nf[None]) <= r[:, None]))
            # every other pivot bounds the distance too; each look is at the pairs left over
            for k in order[1:]:
                if not len(qi):
                    break
                near = abs(tables[0][start + qi, k] - tables[1][fi, k]) <= r[qi]
                qi, fi = qi[near], fi[near]
            d = distances(qs[rows], fs, qi, fi)
            keep = d <= r[qi]
            out.append((start + qi[keep], fi[keep], d[keep]))
        at, to, d = (np.concatenate(x) for x in zip(*out))
        # plain objects: chunked string columns don't pass the Arrow writer
        columns = [q[n].to_numpy(dtype=object)[at] for n in names[:2]] + [f[n].to_numpy(dtype=object)[to] for n in names[2:4]] + [d]
        return pd.DataFrame({n: c.astype("int64") if n in ("party_id", "distance") else pd.Series(c.tolist(), dtype=object) for n, c in zip(names, columns)})

    grouped = salted.groupBy("kind", "cell", "salt").cogroup(copied.groupBy("kind", "cell", "salt"))
    return grouped.applyInPandas(join, "kind string, core string, party_id long, form string, distance int")


def over_cores(df: DataFrame) -> DataFrame:
    """Rows before Python work dealt over all cores, which small shuffle blocks would not be."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def link_names(values: DataFrame, parties: DataFrame) -> DataFrame:
    """(value, party_id) for each distinct typed value that means one registered party.

    values: value, with repeats; blank and null ones are left out. Each different value
    is read once, however many rows hold it. A value nearest to several parties means none.
    """
    distinct = values.where(F.trim("value") != "").select("value").distinct()

    def read(batches):
        for b in batches:
            out = [(v, *c) for v in b.column(0).to_pylist() for c in cores(v)]
            if out:
                a, k, c, e = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k), pa.array(c), pa.array(e, pa.int32())], ["value", "kind", "core", "spent"])

    def write(batches):
        for b in batches:
            out = [(i, *f) for i, n, k in zip(*(c.to_pylist() for c in b.columns)) if n for f in forms(n, k)]
            if out:
                i, k, f = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k), pa.array(f)], ["party_id", "kind", "form"])

    typed = materialize(over_cores(distinct).mapInArrow(read, "value string, kind string, core string, spent int"), "name-cores")
    registered = parties.select(F.col("party_id").cast("long"), "official_name", "kind").mapInArrow(write, "party_id long, kind string, form string")
    # many values come down to one core: each is joined and checked once
    pairs = radius_join(typed.select("kind", "core").distinct(), registered)

    def check(batches):
        for b in batches:
            rows = [(k, c, p, osa(c, f, 9)) for k, c, p, f in zip(*(b.column(n).to_pylist() for n in ("kind", "core", "party_id", "form"))) if agrees(c, f)]
            if rows:
                k, c, p, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(p, pa.int64()), pa.array(e, pa.int32())], ["kind", "core", "party_id", "edits"])

    checked = pairs.mapInArrow(check, "kind string, core string, party_id long, edits int").groupBy("kind", "core", "party_id").agg(F.min("edits").alias("edits"))
    per_party = typed.join(checked, ["kind", "core"]).groupBy("value", "party_id").agg(F.min(F.col("edits") + F.col("spent")).alias("cost"))
    best = per_party.groupBy("value").agg(F.min(F.struct("cost", "party_id")).alias("first"), F.sort_array(F.collect_list("cost")).alias("costs"))
    clear = best.where((F.size("costs") == 1) | (F.element_at("costs", 1) < F.element_at("costs", 2)))
    return clear.select("value", F.col("first.party_id").alias("party_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "decision_metadata")
    parties = table(spark, folder, "parties")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("ministry", "sender", "recipient")])
    typed = rows.select("decision_id", F.inline(fields)).where(F.trim("value") != "")
    links = link_names(typed, parties)
    official = parties.select(F.col("party_id").alias("_id"), F.col("official_name").alias("_name"))
    named = links.join(official, F.col("party_id") == F.col("_id")).where(F.col("value") != F.col("_name"))
    return typed.join(named.select("value", "party_id"), "value").select("decision_id", "field", "party_id")
