"""Readers: SQL scripts, TEI paragraphs, book manifests, JSON lines, catalog guards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_title
from ..operators.documents import natural_sort
from ..operators.segments import allowed


def split_statements(text: str) -> list[str]:
    """Statements of a script, split at semicolons outside strings and comments; comments are dropped."""
    part = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|."
    out, now = [], []
    for m in re.finditer(part, text, re.S):
        t = m[0]
        if t == ";":
            out, now = [*out, "".join(now).strip()], []
        elif not t.startswith(("--", "/*")):
            now.append(t)
    return [s for s in [*out, "".join(now).strip()] if s]


def split_graph_statements(text: str) -> list[str]:
    """Statements of a graph script: comments go first, even inside strings; then split at semicolons outside strings."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    tokens = re.findall(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|\\.?|;|[^\"';\\]+", bare, re.S)
    parts = "".join("\0" if t == ";" else t for t in tokens).split("\0")
    return [p.strip() for p in parts if p.strip()]


def run_script(spark: SparkSession, text: str) -> list[DataFrame]:
    """Run all statements in order; results of those that return columns."""
    return [d for d in map(spark.sql, split_statements(text)) if d.columns]


def scan(spark: SparkSession, name: str, columns: list[str] = ()) -> DataFrame:
    """A table in natural order, then projected."""
    df = natural_sort(spark.table(name))
    return df.select(*columns) if columns else df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and multi-line cells; blank cells are ''."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("allowComments", True).json(path)


def tei_paragraphs(text: str) -> Iterator[tuple[int, str, int, int, int, str]]:
    """(div, head, paragraph, line, line_end, text) in document order; every div counts, nested ones too.

    A div is named by its own first head, else by its type. Lines are those of the file: a paragraph ends
    as many lines on as its trimmed text has line breaks.
    """
    parser, divs, out = expat.ParserCreate(), [], []
    state = {"div": 0, "p": 0, "line": 0, "text": None, "head": None}

    depth: list[str] = []

    def start(name: str, said: dict) -> None:
        name = name.rpartition(":")[2]
        if name == "div":
            state["div"] += 1
            divs.append([state["div"], "", said.get("type", "")])
        elif name == "head" and divs and depth and depth[-1] == "div":
            state["head"] = []
        elif name == "p":
            state.update(text=[], line=parser.CurrentLineNumber)
        elif name == "lb" and state["text"] is not None:
            state["text"].append(" ")
        depth.append(name)

    def end(name: str) -> None:
        name = name.rpartition(":")[2]
        depth.pop()
        if name == "div":
            divs.pop()
        elif name == "head" and state["head"] is not None:
            divs[-1][1], state["head"] = divs[-1][1] or "".join(state["head"]).strip(), None
        elif name == "p" and state["text"] is not None:
            whole, state["text"] = "".join(state["text"]).strip(), None
            if whole and divs:
                state["p"] += 1
                ordinal, head, kind = divs[-1]
                out.append((ordinal, head or kind, state["p"], state["line"], state["line"] + whole.count("\n"), re.sub(r"\s*\n\s*", " ", whole)))

    def data(s: str) -> None:
        for k in ("text", "head"):
            if state[k] is not None:
                state[k].append(s)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(text, True)
    yield from out


def clean_tei(c: Column) -> Column:
    """TEI text with a root element and ids that are names: ``id_`` and the old id, other characters as ``_``."""
    parts = F.split(F.trim(c), 'xml:id="')
    fixed = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(
        F.lit('id_'), F.regexp_replace(F.substring_index(p, '"', 1), "[^a-zA-Z0-9_-]", "_"), F.substr(p, F.instr(p, F.lit('"')))))
    ids = F.array_join(F.concat(F.slice(parts, 1, 1), fixed), 'xml:id="')
    return F.when(ids.rlike(r"<TEI[\s>]"), ids).otherwise(F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0">'), ids, F.lit("</TEI>")))


def epub_to_tei(data: bytes) -> str:
    """An EPUB's spine as TEI: a div for each heading of a part, with its head and paragraphs."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree as ET
    from xml.sax.saxutils import escape

    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
        opf = ET.fromstring(z.read(package))
        hrefs = {e.get("id"): e.get("href") for e in opf.iter() if local(e) == "item"}
        names = [posixpath.join(posixpath.dirname(package), hrefs[e.get("idref")]) for e in opf.iter() if local(e) == "itemref"]
        out, opened = ['<TEI xmlns="http://www.tei-c.org/ns/1.0">'], False
        for name in names:
            for e in ET.fromstring(z.read(name)).iter():
                said, kind = escape("".join(e.itertext()).strip()), local(e)
                if kind in ("h1", "h2", "h3"):
                    out += ["</div>"] * opened + ["<div>", f"<head>{said}</head>"]
                    opened = True
                elif kind == "p" and said:
                    out += ["<div>"] * (not opened) + [f"<p>{said}</p>"]
                    opened = True
    return "\n".join([*out, *["</div>"] * opened, "</TEI>"])


def epub(spark: SparkSession, path: str) -> DataFrame:
    """EPUB files as (path, tei)."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [epub_to_tei(v) for v in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.string())], ["path", "tei"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(convert, "path string, tei string")


def tei_rows(texts: DataFrame) -> DataFrame:
    """Paragraphs of (path, tei): (path, div, head, paragraph, line, line_end, text)."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, v in zip(b.column("path").to_pylist(), b.column("tei").to_pylist(), strict=True):
                rows = [(p, *r) for r in tei_paragraphs(v)] if v else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "div", "head", "paragraph", "line", "line_end", "text"])

    made = "path string, div long, head string, paragraph long, line long, line_end long, text string"
    return texts.select("path", "tei").mapInArrow(parse, made)


def tei(spark: SparkSession, path: str, chapters: list[str] = ()) -> DataFrame:
    """Paragraphs of TEI files, of the chapters whose heads are given (none: all)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("tei"))
    return allowed(tei_rows(files.withColumn("tei", F.ltrim("tei", F.lit("\ufeff")))), list(chapters))


def split_commands(text: str) -> list[str]:
    """JSON commands of a document script: comments go, then split at semicolons outside strings and brackets."""
    out, now, deep = [], [], 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|[\[{]|[\]}]|;|[^"/;\[\]{}]+|.', text, re.S):
        t = m[0]
        if t.startswith(("//", "/*")):
            continue
        deep += (t in "[{") - (t in "]}") if len(t) == 1 else 0
        if t == ";" and deep == 0:
            out, now = [*out, "".join(now).strip()], []
        else:
            now.append(t)
    return [re.sub(r",(\s*[}\]])", r"\1", c) for c in [*out, "".join(now).strip()] if c]


def is_single(text: str, split=split_statements) -> bool:
    """Whether a script is exactly one statement; one of comments only is none."""
    return len(split(text)) == 1


#: Document commands that return no rows.
NO_DATA = ("insert", "update", "delete", "drop", "create", "createIndexes", "dropDatabase")


def returns_rows(command: str) -> bool:
    """Whether a document command, by its first key, asks for rows."""
    import json

    return next(iter(json.loads(command)), "") not in NO_DATA


def connection_string(engine: str, host: str, port: int, name: str = "", user: str = "", password: str = "") -> str:
    from urllib.parse import quote

    who = f"{quote(user, safe='')}:{quote(password, safe='')}@" if user else ""
    return f"{engine}://{who}{host}:{port}" + (f"/{name}" if name else "")


def prompt_file(spark: SparkSession, path: str) -> str:
    """A whole file as one prompt."""
    return spark.read.text(path, wholetext=True).first()[0]


def run_file(spark: SparkSession, path: str) -> list[DataFrame]:
    """``run_script`` of a file."""
    return run_script(spark, prompt_file(spark, path))


def booksum(df: DataFrame, title: str = "title", text: str = "text", summary: str = "summary") -> DataFrame:
    """Book summaries as (title, text, summary) with cleaned titles; ``df`` from any reader of the dataset's files."""
    return df.select(clean_title(F.col(title)).alias("title"), F.col(text).alias("text"), F.col(summary).alias("summary"))


def narrative_qa(df: DataFrame, document: str = "document") -> DataFrame:
    """Stories as (title, author, id) of a nested ``document`` struct, trimmed and lower-cased; a missing field is ''."""
    at = lambda *c: F.lower(F.trim(F.coalesce(F.col(".".join((document, *c))), F.lit(""))))
    return df.select(at("summary", "title").alias("title"), at("author").alias("author"), at("id").alias("id")).distinct()


def create_database(spark: SparkSession, name: str) -> None:
    if spark.catalog.databaseExists(name):
        raise ValueError(f"database {name} exists")
    spark.sql(f"CREATE DATABASE `{name}`")


def drop_database(spark: SparkSession, name: str) -> None:
    if not spark.catalog.databaseExists(name) or spark.catalog.currentDatabase() == name:
        raise ValueError(f"database {name} is missing or in use")
    spark.sql(f"DROP DATABASE `{name}` CASCADE")


@contextmanager
def temporary_database(spark: SparkSession, name: str):
    """Use a database; one that did not exist is dropped afterwards."""
    before, new = spark.catalog.currentDatabase(), not spark.catalog.databaseExists(name)
    if new:
        create_database(spark, name)
    spark.catalog.setCurrentDatabase(name)
    try:
        yield spark
    finally:
        spark.catalog.setCurrentDatabase(before)
        if new:
            drop_database(spark, name)
