"""Queries that do the whole of their job, on small fixtures and against plain Python."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from tests.compare import assert_same, duck


def run(spark, name, folder):
    return entry.queries()[name](spark, str(folder))


def put(folder, table, rows):
    pq.write_table(pa.Table.from_pylist(rows), folder / f"{table}.parquet")


def test_government_types_read_the_text(spark, tmp_path):
    texts = ["مرسوم صادر عن رئيس الجمهورية", "كلمة\n" + "س " * 1_000 + "تعليمات", "س " * 1_500 + "نظام", None]
    put(tmp_path, "loaded_legal_json", [{"record_id": i, "source_file": "قانون.json" if t is None else "a.json", "long_text": t} for i, t in enumerate(texts)])
    got = {r.record_id: (r.type, r.authority) for r in run(spark, "government_types_text", tmp_path).collect()}
    assert got == {0: ("decree", "رئاسة الجمهورية"), 1: ("instruction", None), 2: ("unknown", None), 3: ("law", None)}


def test_summaries_of_every_record(spark, small):
    assert "search_id % 50" not in entry.oracle_sql()["extractive_summary_all"]
    assert_same(run(spark, "extractive_summary_all", small), duck(small), entry.oracle_sql()["extractive_summary_all"])


def test_page_edges_against_plain_python(spark, tmp_path, medium):
    pages = [f"\n h{i}\nرأس  الصفحة\nب {i}\nنص {i}\nتذييل\nم {i}\n\n" for i in range(4)]
    put(tmp_path, "chunks", [{"source_file": "a", "text": t} for t in [*pages, None]] + [{"source_file": "b", "text": "x\ny"}] * 2 + [{"source_file": "c", "text": t} for t in "xyz"])
    assert {tuple(r) for r in run(spark, "repeated_page_edges", tmp_path).collect()} == {("a", "رأس الصفحة", 4), ("a", "تذييل", 4)}
    sources = defaultdict(list)
    for source, text in duck(medium).execute("SELECT source_file, text FROM chunks WHERE text IS NOT NULL AND source_file IS NOT NULL").fetchall():
        if lines := [re.sub(r"[^\S\n]+", " ", x).strip() for x in text.splitlines() if x.strip()]:
            sources[source].append(lines)
    want = set()
    for source, own in sources.items():
        counts = Counter(x for lines in own for x in {*lines[:3], *lines[-2:]})
        want |= {(source, x, n) for x, n in counts.items() if len(own) >= 3 and n >= max(2, len(own) // 2 + 1) and not re.fullmatch(r"(?i:page|صفحة)\s*[0-9٠-٩]+", x)}
    assert want and {tuple(r) for r in run(spark, "repeated_page_edges", medium).collect()} == want
