"""Documents in: files by type, HTML to text, chunks. Whole files are read by Spark, so any store it knows will do."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql import Window as W

BLOCKS = frozenset("p br div li tr table".split()) | {f"h{i}" for i in range(1, 7)}
HIDDEN = frozenset(("script", "style"))
HTML_TYPES, TABLE_TYPES = ("html", "htm", "xhtml"), ("csv", "tsv", "xlsx", "xlsm", "xls")
MAX_CHARS, OVERLAP = 1200, 150


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.hidden == 0 and not data.isspace():
            self.out.append(data)


def py_html_to_text(html: str | None) -> str:
    """Visible text, a line for each block, without blank lines."""
    reader = _Text()
    reader.feed(html or "")
    return "\n".join(x for x in map(str.strip, "".join(reader.out).splitlines()) if x)


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(py_html_to_text)


def _library(name: str, kind: str):
    try:
        return __import__(name)
    except ImportError as e:
        raise RuntimeError(f"{kind} files need the package {name} on the executors") from e


def _pdf(data: bytes) -> str:
    return "\n\n".join(page.extract_text() or "" for page in _library("pypdf", "pdf").PdfReader(io.BytesIO(data)).pages)


def _docx(data: bytes) -> str:
    return "\n".join(p.text for p in _library("docx", "docx").Document(io.BytesIO(data)).paragraphs if p.text.strip())


def _xlsx(data: bytes) -> str:
    """The active sheet, cells joined by bare commas: a comma in a cell shifts the columns after it."""
    sheet = _library("openpyxl", "xlsx").load_workbook(io.BytesIO(data), read_only=True, data_only=True).active
    return "\n".join(",".join("" if c is None else str(c) for c in row) for row in sheet.iter_rows(values_only=True))


def py_extract_text(name: str, data: bytes) -> str:
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    if kind in HTML_TYPES:
        return py_html_to_text(data.decode("utf-8", "ignore"))
    reader = {"pdf": _pdf, "docx": _docx, "xlsx": _xlsx}.get(kind)
    return reader(data) if reader else data.decode("utf-8-sig", "ignore")


@F.pandas_udf(StringType())
def extract_text(name: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([py_extract_text(n, bytes(c)) for n, c in zip(name, content, strict=True)])


def load_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc, text): of files of one name, the one named last by ``paths`` holds."""
    out = None
    for i, path in enumerate(paths):
        name = F.element_at(F.split("path", "/"), -1)
        part = spark.read.format("binaryFile").load(path).select(name.alias("doc"), extract_text(name, F.col("content")).alias("text"), F.lit(i).alias("_i"), "path")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc string, text string")
    return out.groupBy("doc").agg(F.max_by("text", F.struct("_i", "path")).alias("text"))


PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。！？])\s+|\n")


def _units(text: str, most: int) -> Iterator[str]:
    for para in map(str.strip, PARAGRAPH.split(text)):
        if len(para) <= most:
            if para:
                yield para
            continue
        for s in map(str.strip, SENTENCE.split(para)):
            for i in range(0, len(s), most):
                yield s[i : i + most]


def _overlap(s: str, n: int) -> str:
    if len(s) <= n:
        return s
    end = s[len(s) - n :]
    gap = end.find(" ")
    return end[gap + 1 :] if 0 <= gap < n // 2 else end


def py_chunk_text(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs, sentences or pieces, packed in order; a chunk begins with the end of the one before."""
    clean = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    if len(clean) <= max_chars:
        return [clean] if clean else []
    out, cur = [], ""
    for unit in _units(clean, max_chars):
        if not cur:
            cur = unit
        elif len(cur) + 1 + len(unit) <= max_chars:
            cur += "\n" + unit
        else:
            out.append(cur)
            cur = f"{_overlap(cur, overlap)}\n{unit}" if overlap > 0 else unit
    return [c for c in map(str.strip, [*out, cur]) if c]


def chunk_text(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: py_chunk_text(t, max_chars, overlap))

    return F.pandas_udf(run, ArrayType(StringType()))(text)


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id name#i, doc, chunk_text, chunk_index) of (doc, text)."""
    parts = docs.select("doc", F.posexplode(chunk_text(F.col("text"), max_chars, overlap)).alias("chunk_index", "chunk_text"))
    return parts.select(F.concat_ws("#", "doc", F.col("chunk_index").cast("string")).alias("chunk_id"), "doc", "chunk_text", "chunk_index")


def is_table_file(doc: Column) -> Column:
    return F.lower(F.regexp_extract(doc, "\\.([^.]*)$", 1)).isin(*TABLE_TYPES)


def normalize_documents(docs: DataFrame, chunk: bool = False, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, doc, text, chunk_index) of (doc, text) or ready chunks (doc, chunk_id?, chunk_text, chunk_index?): tables stay whole."""
    if "chunk_text" in docs.columns:
        order = F.col("chunk_index") if "chunk_index" in docs.columns else F.monotonically_increasing_id()
        place = F.row_number().over(W.partitionBy("doc").orderBy(order)) - 1
        ident = F.col("chunk_id") if "chunk_id" in docs.columns else F.lit(None).cast("string")
        numbered = docs.withColumn("_n", place)
        return numbered.select(F.coalesce(F.nullif(ident, F.lit("")), F.concat_ws("#", "doc", F.col("_n").cast("string"))).alias("id"), "doc", F.col("chunk_text").alias("text"), F.col("_n").cast("int").alias("chunk_index"))
    whole = docs.select(F.concat("doc", F.lit("#0")).alias("id"), "doc", "text", F.lit(0).alias("chunk_index"))
    if not chunk:
        return whole
    cut = chunk_documents(docs.filter(~is_table_file(F.col("doc"))), size, overlap).select(F.col("chunk_id").alias("id"), "doc", F.col("chunk_text").alias("text"), "chunk_index")
    return whole.filter(is_table_file(F.col("doc"))).unionByName(cut)


def strip_headers(text: Column, patterns: list[str]) -> Column:
    """Without what ingestion put before the text; patterns are the caller's."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


SHEET = "(?i)^\\s*\\[Sheet:\\s*([^\\]]+)\\]"


def split_sheets(chunks: DataFrame) -> DataFrame:
    """Chunks with ``table``: doc#sheet=x where a doc has several sheets, else doc."""
    sheet = F.trim(F.regexp_extract(F.regexp_replace("text", "(?s)<Document-Metadata>.*?</Document-Metadata>", ""), SHEET, 1))
    marked = chunks.withColumn("_sheet", sheet)
    several = marked.groupBy("doc").agg((F.countDistinct("_sheet") > 1).alias("_many"))
    name = F.when(F.col("_many") & (F.col("_sheet") != ""), F.concat("doc", F.lit("#sheet="), "_sheet")).otherwise(F.col("doc"))
    return marked.join(several, "doc").withColumn("table", name).drop("_sheet", "_many")


def rows_to_csv(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(line): rows as CSV, in the order of columns."""
    cols = columns or rows.columns
    return rows.select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])).alias("line"))
