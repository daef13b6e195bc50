import io
import json
import zipfile

import pytest

from sijill.operators import chunking as C
from sijill.sources import documents as D
from sijill.sources import records as R
from sijill.streaming import ingest as S

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, rows=()):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>" if rows else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def test_decoders():
    assert D.decode("html", b"<h1>A</h1><p>B <b>C</b></p>")[1] == ["A", "B", "C"]
    assert D.decode("md", b"# A\n\n- *b*\n> c")[1] == ["A", "b", "c"]
    assert D.rtf_text(rb"{\rtf1\ansi {\*\gen x;}one\par two \b three}", True) == "one\ntwo three"
    text, paragraphs, tables = D.decode("docx", docx(["first", "", "second"], [["a", ""], ["b", "c"]]))
    assert paragraphs == ["first", "second", "a", "b", "c"] and tables == [[["a"], ["b", "c"]]] and text == "first\nsecond\na\nb\nc"
    assert D.decode("docx", docx(["x"], [["b", "c"]]), table_rows=True)[0].endswith("b | c") and D.decode("docx", docx(["x", ""]), keep_empty=True)[1] == ["x", ""]
    assert D.decode("docx", docx(["x  y"], [["b", "c"]]), government=True)[0] == "x y\nb\nc\nb | c"
    assert D.rtf_text(rb"{\rtf1\ansicpg1256\uc1{\fonttbl{\f0 Arial;}}{\stylesheet{\s0 Normal;}}\u1602?\u1585?\'c7\'d1\tab x\\\{\par{\i deep {\b er}}}") == "قرار\tx\\{\ndeep er"
    assert D.rtf_text("{\\rtf1 قرار}".encode()) == "قرار"
    with pytest.raises(ValueError):
        D.decode("xyz", b"")


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("سطر\n\nثان", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(docx(["x"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.exe").write_bytes(b"x")
    rows = {r.filename: r for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].paragraphs == ["سطر", "ثان"] and rows["b.docx"].raw_text == "x"
    assert rows["c.docx"].error and rows["d.exe"].error.startswith("unsupported")
    assert D.paragraphs(D.read_documents(spark, str(tmp_path))).count() == 3
    assert [r.extension for r in D.unsupported_files(spark, str(tmp_path)).collect()] == ["exe"]
    only = D.read_documents(spark, str(tmp_path), extensions=("docx",))
    assert sorted(r.filename for r in only.collect()) == ["b.docx", "c.docx"]
    assert sorted(r.batch for r in D.file_batches(only.select("path"), 1).collect()) == [0, 1]


def test_pages(spark):
    df = spark.createDataFrame([("a", "one\f\ftwo"), ("b", None), ("c", " ")], "path string, raw_text string")
    assert sorted(map(tuple, D.pages(df).collect())) == [("a", 1, "one"), ("a", 3, "two")]


def test_registry_is_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert R.load_registry(spark, path).count() == 0
    rows = spark.createDataFrame([("1", "l", "a"), ("2", "l", "a"), ("2", "l", "a")], "chunk_id string, law string, article string")
    R.save_registry(rows, path)
    assert sorted(map(tuple, R.load_registry(spark, path).collect())) == [("1", "l", "a"), ("2", "l", "a")]
    head = R.registry_head(spark, path).first()
    assert (head.schema_version, head.chunk_count, head.n_laws) == (1, 2, 1)


def test_json_tables_are_updated(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "id string, n int")
    R.update_records(make([("a", 1), ("b", 2)]), path, ["id"])
    R.update_records(make([("b", 3), ("c", 4)]), path, ["id"])
    assert sorted((r.id, r.n) for r in spark.read.json(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_chunk_index_replaces_a_source(spark, tmp_path):
    path = str(tmp_path / "index")
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, source_file string, text string")
    R.index_chunks(make([("1", "f", "a"), ("2", "f", "b"), ("3", "g", "c"), ("3", "g", "c")]), path)
    R.index_chunks(make([("9", "f", "z"), ("9", "f", "y")]), path)
    got = sorted((r.chunk_id, r.source_file, r.text) for r in spark.read.parquet(path).collect())
    assert got == [("3", "g", "c"), ("9", "f", "y"), ("9-dup-1", "f", "z")]


def test_chunk_records(spark, tmp_path):
    good = {"chunk_id": "1", "text": "t", "source_file": "f"}
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"chunk_id": "2", "text": " "})]))
    assert [r.chunk_id for r in R.read_chunk_records(spark, str(tmp_path / "c.jsonl")).collect()] == ["1"]
    with pytest.raises(Exception):
        R.read_chunk_records(spark, str(tmp_path / "c.jsonl"), strict=True).collect()
    (tmp_path / "d.jsonl").write_text("\n".join([json.dumps(good)] * 2))
    with pytest.raises(Exception, match="repeated"):
        R.read_chunk_records(spark, str(tmp_path / "d.jsonl"), strict=True).collect()


def test_repository_and_sinks(spark, tmp_path):
    for name, body in (("a", {"id": "1", "title": "x"}), ("b", {"id": "1", "title": "y"}), ("c", {"id": "2", "title": "z"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    docs = R.read_repository(spark, str(tmp_path))
    assert sorted((r.id, r.title) for r in docs.collect()) == [("1", "x"), ("2", "z")]
    out = str(tmp_path / "out")
    R.write_chunks(spark.createDataFrame([("f", 1), ("g", 2)], "source string, n int"), out, "source")
    R.write_chunks(spark.createDataFrame([("f", 3)], "source string, n int"), out, "source")
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [2, 3]


def test_transcript(spark):
    turns = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", "x")], "conv_id int, turn int, role string, text string")
    assert R.transcript(turns).first().transcript == "a: x\nb: y"


def test_overlap_chunks():
    text = "جملة قصيرة جدا هنا. " * 400
    chunks = C.overlap_chunks(text)
    assert all(len(c) <= C.MOST for c in chunks) and all(len(c) >= C.LEAST for c in chunks[:-1])
    assert all(c.endswith(".") for c in chunks) and C.overlap_chunks("") == [] and C.overlap_chunks(" a ") == ["a"]
    assert len(C.overlap_chunks("x" * 4000)) == 3


def test_packed_sentences():
    parts = C.packed_sentences("جملة أولى. " * 300)
    assert all(len(p) <= C.PACK_MOST for p in parts) and "".join(parts).count("جملة") == 300
    assert C.packed_sentences("  ") == [] and C.packed_sentences("a") == ["a"]


def test_stream(spark, small, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{small}/chunks.parquet").selectExpr("row_id", "chunk_id", "text", "source_file", "indexed_at", "is_deleted")
    rows.union(rows.limit(5)).repartition(1).write.parquet(str(source))
    stream = S.chunk_stream(spark, str(source), "5000 days")
    S.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
