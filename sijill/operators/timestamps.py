"""Problem 1: timestamps in mixed notations, precisions and zones.

Raw strings are reduced to a dictionary of distinct (text, zone) pairs, each pair
is parsed once, the dictionary is kept as a table that later runs only extend, and
the normal forms are joined back to the rows.
"""

from __future__ import annotations

import hashlib
import inspect
import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import exists, kept_path, table

DEFAULT_ZONE = "Asia/Baghdad"

# Month names as written in English, in the eastern and western Arab
# countries and in Sorani Kurdish, after folding (see _fold).
MONTHS = {
    1: "january jan|يناير|كانون الثاني|كانون ثاني|ك2|جانفي|کانوونی دووەم",
    2: "february feb|فبراير|شباط|فيفري|شوبات",
    3: "march mar|مارس|اذار|ئازار",
    4: "april apr|ابريل|نيسان|افريل|نیسان",
    5: "may|مايو|ايار|ماي|ئایار",
    6: "june jun|يونيو|حزيران|جوان|حوزەیران",
    7: "july jul|يوليو|تموز|جويليه|تەمموز",
    8: "august aug|اغسطس|اب|اوت|ئاب",
    9: "september sept sep|سبتمبر|ايلول|ئەیلوول",
    10: "october oct|اكتوبر|تشرين الاول|تشرين اول|ت1|تشرینی یەکەم",
    11: "november nov|نوفمبر|تشرين الثاني|تشرين ثاني|ت2|تشرینی دووەم",
    12: "december dec|ديسمبر|كانون الاول|كانون اول|ك1|کانوونی یەکەم",
}
# Weekday names, which are read over.
WEEKDAYS = (
    "monday mon tuesday tues tue wednesday wed thursday thurs thur thu friday fri saturday sat sunday sun "
    "الاثنين الاثنين الثلاثاء الاربعاء الخميس الجمعه السبت الاحد اثنين ثلاثاء اربعاء خميس جمعه سبت احد "
    "شەممە یەکشەممە دووشەممە سێشەممە چوارشەممە پێنجشەممە هەینی"
).split()
# Zone abbreviations of Europe and North America, in minutes from UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HAST": -600, "HADT": -540,
}

_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁩﻿ً-ْـ]")
_FOLD = {ord(a): b for a, b in zip("أإآٱىةیکہ", "ااااىهيكه")} | {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x2215: "/", 0x2044: "/", 0x060C: ",", 0x066B: "."}
for _zero in (0x660, 0x6F0, 0xFF10):
    _FOLD |= {_zero + d: str(d) for d in range(10)}
_FOLD |= {0xFF00 + c - 0x20: chr(c) for c in range(0x21, 0x7F) if not 0x30 <= c <= 0x39}


def _fold(text: str) -> str:
    """Digits, width, hyphens, blanks and hamza seats in one form; marks without width removed."""
    return re.sub(r"\s+", " ", _INVISIBLE.sub("", text).translate(_FOLD)).strip()


_MONTH_OF = {_fold(n): m for m, names in MONTHS.items() for part in names.split("|") for n in (part.split(" ") if part.isascii() else [part])}
_NAME = "|".join(sorted(map(re.escape, _MONTH_OF), key=len, reverse=True))
_WEEKDAY = re.compile(rf"^(?:يوم )?(?:{'|'.join(sorted({_fold(w) for w in WEEKDAYS}, key=len, reverse=True))})(?:\.|\b)\s*[,]?\s*(?:الموافق |المصادف )?", re.I)
_DAYS = [
    re.compile(r"(?P<y>\d{4})\s*([-/.])\s*(?P<m>\d{1,2})\s*\2\s*(?P<d>\d{1,2})"),
    re.compile(r"(?P<d>\d{1,2})\s*([-/.])\s*(?P<m>\d{1,2})\s*\2\s*(?P<y>\d{4}|\d{2})"),
    re.compile(rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?: of)?[\s,./-]*(?P<n>{_NAME})\.?[\s,./-]*(?P<y>\d{{4}}|\d{{2}})", re.I),
    re.compile(rf"(?P<n>{_NAME})\.?[\s/-]*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s,./-]+(?P<y>\d{{4}})", re.I),
    re.compile(rf"(?P<y>\d{{4}})[\s,./-]*(?P<n>{_NAME})\.?[\s,./-]*(?P<d>\d{{1,2}})", re.I),
    re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"),
]
_CLOCK = re.compile(r"(?P<h>\d{1,2}):(?P<i>\d{1,2})(?::(?P<s>\d{1,2})(?:[.,](?P<f>\d{1,9}))?)?")
_COMPACT = re.compile(r"(\d{8})[T ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(?=$|[ Z+-])")
_HALF = re.compile(r"^(a\.?m\.?|p\.?m\.?|صباحا|مساء|ظهرا|ص|م)(?![^\W\d_])\s*", re.I)
_OFFSET = re.compile(r"^(?:UTC|GMT|UT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::00)?\s*(?:\[[^\]]*\]|\([^)]*\))?$", re.I)
_JOINT = re.compile(r"(?:(?<=\d)T|الساعه|at|في|,|-|\s)+$", re.I)


@lru_cache(maxsize=2048)
def _zone(name: str):
    """A tzinfo for an offset, an abbreviation or a region; None where unknown."""
    if m := _OFFSET.match(name):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if minutes > 18 * 60 or int(m[3] or 0) > 59:
            return None
        return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes))
    name = name.strip("[]() ")
    if name.upper() in ABBREVIATIONS:
        return timezone(timedelta(minutes=ABBREVIATIONS[name.upper()]))
    if "/" in name and re.fullmatch(r"[A-Za-z0-9_+/-]+", name) and not name.startswith("/"):
        try:
            return ZoneInfo("/".join(p if "_" in p or not p.islower() else p.title() for p in name.split("/")))
        except Exception:
            return None
    return None


def _day(text: str) -> date | None:
    text = _WEEKDAY.sub("", text).strip(" ,.")
    text = re.sub(r"(?<=\d)\s*(?:م|ميلاديه?)$", "", text)
    for pattern in _DAYS:
        if m := pattern.fullmatch(text):
            g = m.groupdict()
            year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
            month = int(g["m"]) if g.get("m") else _MONTH_OF[g["n"].lower()]
            try:
                return date(year, month, int(g["d"]))
            except ValueError:
                return None
    return None


def _moment(day: date, h: int, i: int, s: int, frac: str, zone) -> str | None:
    if h > 23 or i > 59 or s > 59 or zone is None:
        return None
    try:
        wall = datetime(day.year, day.month, day.day, h, i, s, int((frac or "0").ljust(6, "0")[:6]))
        at = wall.replace(tzinfo=zone, fold=0).astimezone(timezone.utc)
        if at.astimezone(zone).replace(tzinfo=None) != wall:
            return None  # skipped when the clocks went forward
        return at.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0")
    except (ValueError, OverflowError):
        return None


def normalise(raw: str | None, source_zone: str | None, default_zone: str = DEFAULT_ZONE) -> str | None:
    """The normal form of one value, or None where it can't be read."""
    if raw is None:
        return None
    text = _fold(raw)
    if re.fullmatch(r"\d{10,19}", text):
        n = int(text)
        micros = n * 1_000_000 if n < 10**11 else n * 1000 if n < 10**14 else n
        try:
            at = datetime(1970, 1, 1) + timedelta(microseconds=micros)
        except OverflowError:
            return None
        return at.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0")
    if m := _COMPACT.match(text):
        day, clock, rest = _day(m[1]), (int(m[2]), int(m[3]), int(m[4] or 0), m[5]), text[m.end() :].strip()
    elif m := _CLOCK.search(text):
        before, rest = text[: m.start()], text[m.end() :].strip()
        day = _day(_JOINT.sub("", before))
        if day is None and not before.strip():
            # the clock may stand first
            half = _HALF.match(rest)
            day, rest = _day(_JOINT.sub("", re.sub(r"^(?:,|-|في|on)?\s*", "", rest[half.end() if half else 0 :]))), half[0] if half else ""
        clock = (int(m["h"]), int(m["i"]), int(m["s"] or 0), m["f"])
    else:
        day = _day(text)
        return None if day is None else day.isoformat()
    if day is None:
        return None
    h = clock[0]
    if half := _HALF.match(rest):
        rest = rest[half.end() :].strip()
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half[1][0].lower() in "pم" or half[1].startswith("ظ") else 0)
    zone = _zone(rest) if rest else _zone(source_zone.strip()) if source_zone and source_zone.strip() else ZoneInfo(default_zone)
    return _moment(day, h, *clock[1:], zone)


def _parse_batches(batches):
    for batch in batches:
        raws, zones = batch.column("raw").to_pylist(), batch.column("zone").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("raw"), batch.column("zone"), pa.array([normalise(r, z) for r, z in zip(raws, zones)], pa.string())], ["raw", "zone", "normal_form"]
        )


class TimestampDictionary:
    """The distinct-value dictionary (raw, zone, normal_form), kept as a parquet table.

    `extend` parses only pairs that the table doesn't hold yet and appends them, so a
    pair is parsed once over all runs. Unreadable pairs are kept with a null form.
    """

    SCHEMA = "raw string, zone string, normal_form string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All pairs; writers at the same time may have appended one twice, so readers group them."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def extend(self, values: DataFrame) -> DataFrame:
        """values: raw, zone, with repeats; the distinct step combines before its shuffle."""
        new = values.where(F.col("raw").isNotNull()).select("raw", "zone").distinct()
        if exists(self.spark, self.path):
            new = new.alias("n").join(self.read().alias("k"), F.expr("n.raw = k.raw AND n.zone <=> k.zone"), "left_anti")
        # the parse is Python: dealt over all cores, which small shuffle blocks would not be
        new = new.repartition(self.spark.sparkContext.defaultParallelism, F.xxhash64("raw", "zone"))
        new.mapInArrow(_parse_batches, self.SCHEMA).write.mode("append").parquet(self.path)
        return self.read()


def normalise_timestamps(df: DataFrame, key: str, fields: list[str], zone: str, dictionary: TimestampDictionary) -> DataFrame:
    """One row (key, field, normal_form) for each readable value of the fields.

    Null values, unreadable ones and an empty table give no rows; repeated rows each
    give theirs; columns besides key, fields and zone don't matter. A value that a
    third of the rows share is one entry of the dictionary, and the adaptive skew join
    splits its rows on the way back.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])
    rows = df.select(F.col(key).alias("_key"), F.col(zone).cast("string").alias("zone"), F.inline(pairs)).where(F.col("raw").isNotNull())
    # a null zone has a key too, so the dictionary's grouping and the join share one shuffle
    zoned = F.coalesce(F.concat(F.lit("+"), "zone"), F.lit(""))
    known = dictionary.extend(rows).groupBy("raw", zoned.alias("zoned")).agg(F.max("normal_form").alias("normal_form"))
    hit = known.where(F.col("normal_form").isNotNull())
    return rows.withColumn("zoned", zoned).join(hit, ["raw", "zoned"]).select(F.col("_key").alias(key), "field", "normal_form")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "search_records")
    # a grammar of its own has a dictionary of its own
    grammar = hashlib.md5(inspect.getsource(inspect.getmodule(normalise)).encode()).hexdigest()
    dictionary = TimestampDictionary(spark, kept_path(spark, f"timestamps-{grammar}"))
    return normalise_timestamps(rows, "search_id", ["issue_date", "session_date"], "source_zone", dictionary)
