"""Sources and sinks: text, DOCX and spreadsheet files, and pluggable extractors for what needs outside programs."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiforge.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_text(data: bytes) -> str:
    """UTF-8, else windows-1251, where undefined bytes are dropped."""
    try:
        return data.decode("utf-8").strip()
    except UnicodeDecodeError:
        return data.decode("cp1251", "ignore").strip()


def docx_text(data: bytes) -> str:
    """The paragraphs that aren't blank; tables are left out."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    own = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in (body if body is not None else []) if p.tag == f"{_W}p"]
    return "\n".join(p for p in own if p.strip())


#: Extension to extractor. PDF, DOC and image extractors need outside programs: register one to read them.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": decode_text, "docx": docx_text}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, ext (look-alike letters mended, S8) and content of the files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", T.latin_extension(F.substring_index("path", ".", -1)).alias("ext"), "content", F.sha2("content", 256).alias("hash"))


def documents(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, hash, text, error of the files in path; a file that has no extractor or fails is a row with its error (M5)."""
    own = EXTRACTORS | (extractors or {})

    @F.pandas_udf(StringType())
    def extract(ext: pd.Series, content: pd.Series) -> pd.Series:
        def one(e, c):
            if e not in own:
                return "!unsupported type: " + e
            try:
                return "=" + own[e](c)
            except Exception as failure:  # noqa: BLE001  a bad file is a result
                return f"!{type(failure).__name__}: {failure}"

        return pd.Series([one(e, c) for e, c in zip(ext, content)])

    rows = files(spark, path).withColumn("x", extract("ext", "content"))
    good = F.startswith("x", F.lit("="))
    return rows.select("path", "hash", F.when(good, F.substring("x", 2, 1 << 30)).alias("text"), F.when(~good, F.substring("x", 2, 1 << 30)).alias("error"))


def sheet(spark: SparkSession, candidates: list[str], width: int = 10) -> DataFrame:
    """row_no, cells of the first candidate CSV that has a filled cell, without its header; an empty table if none has."""
    from pyspark.errors import AnalysisException

    columns = [f"c{k}" for k in range(width)]
    for path in candidates:
        try:
            rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("multiLine", "true").option("mode", "PERMISSIVE").csv(path)
            if rows.filter(" or ".join(f"trim({c}) <> ''" for c in columns)).isEmpty():
                continue
        except AnalysisException:
            continue
        numbered = rows.select(F.monotonically_increasing_id().alias("row_no"), F.array(*columns).alias("cells"))
        return numbered.filter("row_no > 0")
    return spark.createDataFrame([], "row_no long, cells array<string>")


def fetched_sheet(spark: SparkSession, urls: list[str], fetch: Callable[[str], tuple[int, bytes]]) -> DataFrame:
    """row_no, cells of the first address whose answer (fetch: address to status and content) is 200 and a CSV with a filled cell; raises if none is.

    A sheet is read by the driver whole, as the service sends it; rows keep their own number of cells, the header included (row 0)."""
    failure = "no address"
    for url in urls:
        try:
            status, content = fetch(url)
            rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline="")))
        except Exception as e:  # noqa: BLE001  the next address may do
            failure = f"{url}: {type(e).__name__}: {e}"
            continue
        # One line without a separator is a message rather than a table.
        table = len(rows) > 1 or any(len(r) > 1 or ";" in r[0] or content.endswith(b"\n") for r in rows if r)
        if status == 200 and table and any(c.strip() for r in rows for c in r):
            return spark.createDataFrame(list(enumerate(rows)), "row_no long, cells array<string>")
        failure = f"{url}: status {status}, {len(rows)} rows"
    raise ValueError(f"no sheet: {failure}")


_PACKAGE = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
#: Characters that XML can't hold.
_UNWRITABLE = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def docx_bytes(body: str | None, title: str | None = None, pairs: list[tuple[str, str]] | None = None) -> bytes:
    """A DOCX file with a heading, a paragraph for each line of body, and a table of pairs, whose second side is marked yellow.

    Null and empty texts are empty paragraphs or cells; characters that XML can't hold are left out."""
    root = ET.Element(f"{_W}document")
    out = ET.SubElement(root, f"{_W}body")

    def paragraph(under: ET.Element, text: str | None, style: str = "", color: str = "") -> None:
        p = ET.SubElement(under, f"{_W}p")
        if style:
            ET.SubElement(ET.SubElement(p, f"{_W}pPr"), f"{_W}pStyle", {f"{_W}val": style})
        run = ET.SubElement(p, f"{_W}r")
        if color:
            ET.SubElement(ET.SubElement(run, f"{_W}rPr"), f"{_W}highlight", {f"{_W}val": color})
        ET.SubElement(run, f"{_W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = _UNWRITABLE.sub("", text or "")

    if title is not None:
        paragraph(out, title, "Heading1")
    for line in (body or "").split("\n"):
        paragraph(out, line)
    if pairs:
        table = ET.SubElement(out, f"{_W}tbl")
        for pair in pairs:
            row = ET.SubElement(table, f"{_W}tr")
            for text, color in zip(pair, ("", "yellow")):
                paragraph(ET.SubElement(row, f"{_W}tc"), text, color=color)
        paragraph(out, "")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PACKAGE.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        z.writestr("word/document.xml", ET.tostring(root, encoding="utf-8", xml_declaration=True))
    return held.getvalue()


def docx_reports(rows: DataFrame, key: str) -> DataFrame:
    """Key and docx (binary) of each row's title and body; workers render them, and any sink stores the column."""

    @F.pandas_udf("binary")
    def render(title: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([docx_bytes(b, t) for t, b in zip(title, body)], dtype=object)

    return rows.select(key, render("title", "body").alias("docx"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A header and tab-separated pairs; tabs inside become blanks."""
    pairs.select(*[F.regexp_replace(c, r"[\t\r\n]", " ").alias(c) for c in ("original", "recognized")]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
