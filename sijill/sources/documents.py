"""Documents from files: text, Markdown, HTML, RTF, Word and, where a reader is installed, PDF (survey 2.1)."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("txt", "md", "html", "htm", "rtf", "docx", "pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, filename string, extension string, raw_text string, paragraphs array<string>, tables array<array<array<string>>>, error string"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(raw: bytes) -> str:
    parser = _Text()
    parser.feed(raw.decode("utf-8", "replace"))
    return "\n".join(parser.parts)


def markdown_text(raw: bytes) -> str:
    lines = raw.decode("utf-8-sig", "replace").splitlines()
    return "\n".join(re.sub(r"[*_`]+", "", re.sub(r"^\s*(?:#{1,6}|[-*+]|>)\s+", "", line)) for line in lines)


_RTF = re.compile(r"\\(?:([a-zA-Z]+)(-?\d+)? ?|'([0-9a-fA-F]{2})|([^a-zA-Z]))|([{}])|([^\\{}\r\n]+)")
# RTF words for breaks, and groups that hold no text of the document.
_RTF_BREAKS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t"}
_RTF_APART = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable", "listoverridetable"}


def rtf_text(raw: bytes, government: bool = False) -> str:
    """Plain text of RTF, read token by token: groups nest, starred ones and tables of fonts, colours and styles are left out.

    Coded characters go by the document's code page, Unicode ones replace the fallback
    that follows them. The government profile keeps one line a paragraph without tabs.
    """
    text = raw.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", text)
    code = f"cp{page[1]}" if page else "cp1256"
    # the state of each open group: whether it is left out, and how many fallback characters follow a Unicode one
    groups, out, drop, opened = [(False, 1)], [], 0, False
    for m in _RTF.finditer(text):
        word, number, hexed, symbol, brace, plain = m.groups()
        hidden, fallback = groups[-1]
        if brace == "{":
            groups.append((hidden, fallback))
            opened = True
            continue
        if brace == "}":
            if len(groups) > 1:
                groups.pop()
            drop = 0
        elif word == "uc":
            groups[-1] = (hidden, int(number or 1))
        elif word == "u" and number:
            if not hidden:
                out.append(chr(int(number) % 65536))
            drop = fallback
        elif symbol == "*" or word in _RTF_APART and opened:
            groups[-1] = (True, fallback)
        elif hexed:
            if drop:
                drop -= 1
            elif not hidden:
                out.append(bytes([int(hexed, 16)]).decode(code, "replace"))
        elif word in _RTF_BREAKS and not hidden:
            out.append(" " if government and _RTF_BREAKS[word] == "\t" else _RTF_BREAKS[word])
        elif symbol and symbol in "\\{}~-_" and not hidden:
            out.append({"~": "\u00a0", "-": "", "_": "-"}.get(symbol, symbol))
        elif plain:
            own, drop = plain[drop:], max(0, drop - len(plain))
            if not hidden:
                # text outside the control words may be UTF-8, which some writers leave as it is
                try:
                    own = own.encode("latin-1").decode("utf-8")
                except UnicodeDecodeError:
                    own = own.encode("latin-1").decode(code, "replace")
                out.append(own)
        opened = False
    return "".join(out).strip()


def word_parts(raw: bytes, keep_empty: bool = False) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs, those in table cells too, and tables of non-empty cells, in document order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))

    def text(node) -> str:
        out = []
        for x in node.iter():
            out.append({f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, (x.text or "") if x.tag == f"{_W}t" else ""))
        return "".join(out)

    paragraphs = [text(p) if keep_empty else text(p).strip() for p in root.iter(f"{_W}p")]
    tables = []
    for t in root.iter(f"{_W}tbl"):
        rows = [[c for c in (text(cell).strip() for cell in row.iter(f"{_W}tc")) if c] for row in t.iter(f"{_W}tr")]
        tables.append([r for r in rows if r])
    return [p for p in paragraphs if p or keep_empty], tables


def pdf_text(raw: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def paragraphs_of(text: str) -> list[str]:
    return [p for p in (x.strip() for x in re.split(r"\n\s*\n|\n", text)) if p]


def profile_text(text: str) -> str:
    """The government profile's text: form feeds as line ends, blanks squeezed, at most one empty line."""
    text = re.sub(r"[^\S\n]+", " ", text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n").replace("\u200f", "").replace("\u200e", ""))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in text.split("\n"))).strip()


def decode(extension: str, raw: bytes, government: bool = False, keep_empty: bool = False, table_rows: bool = False) -> tuple[str, list[str], list]:
    """(raw_text, paragraphs, tables) of one file; ValueError for a kind that isn't supported.

    keep_empty keeps Word's empty paragraphs; table_rows, and always the government
    profile, adds the rows of its tables to the text.
    """
    if extension == "docx":
        paragraphs, tables = word_parts(raw, keep_empty)
        rows = [" | ".join(r) for t in tables for r in t] if table_rows or government else []
        text = "\n".join([*paragraphs, *rows])
        return (profile_text(text) if government else text), paragraphs, tables
    readers = {"txt": lambda b: b.decode("utf-8-sig", "replace"), "md": markdown_text, "html": html_text, "htm": html_text, "rtf": lambda b: rtf_text(b, government), "pdf": pdf_text}
    if extension not in readers:
        raise ValueError(f"unsupported file type: {extension}")
    text = readers[extension](raw)
    text = profile_text(text) if government else text
    return text, paragraphs_of(text), []


def read_documents(spark: SparkSession, path: str | list[str], recursive: bool = False, government: bool = False, keep_empty: bool = False, table_rows: bool = False, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each file; unreadable and unsupported ones say so in `error` and have no text.

    With `extensions` only files of these kinds are read; others are not opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))

    def run(frames):
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"]):
                base = name.rsplit("/", 1)[-1]
                extension = base.rsplit(".", 1)[-1].lower() if "." in base else ""
                try:
                    text, paragraphs, tables = decode(extension, bytes(content), government, keep_empty, table_rows)
                    out.append((name, base, extension, text, paragraphs, tables, None))
                except Exception as e:
                    out.append((name, base, extension, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "filename", "extension", "raw_text", "paragraphs", "tables", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def paragraphs(documents: DataFrame) -> DataFrame:
    """One row for each paragraph, with its place."""
    return documents.select("path", F.posexplode("paragraphs").alias("index", "text"))


def unsupported_files(spark: SparkSession, path: str, recursive: bool = False, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(path, extension) of the files that no reader takes; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", extension.alias("extension")).where(~F.col("extension").isin(*supported))


def file_batches(files: DataFrame, size: int) -> DataFrame:
    """Files with the number of the batch that they go into, of `size` each, in order of path. A list of paths is small beside the files."""
    from pyspark.sql import Window as W

    return files.withColumn("batch", F.floor((F.row_number().over(W.orderBy("path")) - 1) / size).cast("int"))


def pages(documents: DataFrame) -> DataFrame:
    """(path, page, text): the text between form feeds, page by page from 1; pages without text are left out."""
    split = documents.select("path", F.posexplode(F.split("raw_text", "\f")).alias("pos", "text"))
    return split.where(F.trim("text") != "").select("path", (F.col("pos") + 1).alias("page"), F.trim("text").alias("text"))
