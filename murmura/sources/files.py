"""Documents from folders, and what the engine writes."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.operators.chunking import identity

TEXT, LENIENT_TEXT = ("txt", "md"), ("", "txt", "md", "csv", "log")
OFFICE = ("pdf", "docx", "xlsx", "xls", "pptx")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def kind(path: Column, lenient: bool = False) -> Column:
    """'text', an office format, or '' for files that aren't read."""
    s, texts = suffix(path), LENIENT_TEXT if lenient else TEXT
    is_text = s.isin(*texts)
    if lenient:
        is_text = is_text | file_name(path).rlike("^[0-9]+$")
    return F.when(is_text, "text").when(s.isin(*OFFICE), s).otherwise("")


def decode(content: Column, lenient: bool = False) -> Column:
    """UTF-8; else '' , or latin-1 when lenient."""
    ok = F.is_valid_utf8(content.cast("string"))
    other = F.decode(content, "ISO-8859-1") if lenient else F.lit("")
    return F.when(ok, content.cast("string")).otherwise(other)


def _tags(data: bytes, name: str, tag: str) -> Iterator[ElementTree.Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for member in sorted((m for m in z.namelist() if m.startswith(name)), key=lambda m: (len(m), m)):
            yield from (e for e in ElementTree.fromstring(z.read(member)).iter() if e.tag.rpartition("}")[2] == tag)


def _inner(e: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] == tag)


def read_docx(data: bytes) -> str:
    return "\n".join(_inner(p) for p in _tags(data, "word/document.xml", "p"))


def read_pptx(data: bytes) -> str:
    return "".join(_inner(p) + "\n" for p in _tags(data, "ppt/slides/slide", "p"))


def read_xlsx(data: bytes) -> str:
    """The first sheet, tab-separated."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
    shared = [_inner(s) for s in _tags(data, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
    lines = []
    for row in _tags(data, "xl/worksheets/sheet1.xml", "row"):
        cells = []
        for c in (x for x in row if x.tag.rpartition("}")[2] == "c"):
            value = _inner(c, "v") or _inner(c, "t")
            cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
        lines.append("\t".join(cells))
    return "\n".join(lines)


def read_pdf(data: bytes, between: str = "") -> str:
    import pypdf  # an optional library: without it such files fail

    return between.join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


def read_lenient_pdf(data: bytes) -> str:
    return read_pdf(data, "\n")


READERS: dict[str, Callable[[bytes], str]] = {"pdf": read_pdf, "lenient pdf": read_lenient_pdf, "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}


def _read_office(data: bytes, k: str) -> tuple[str | None, str | None]:
    if k not in READERS:
        return None, f"{k} files aren't read"
    try:
        return READERS[k](data), None
    except Exception as e:  # damaged in one of many ways
        return None, f"{type(e).__name__}: {e}"[:200]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def office_text(content: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    """The text of office files, or why there is none; null for files of other kinds."""
    rows = [(None, None) if d is None else _read_office(d, k) for d, k in zip(content, kinds)]
    return pd.DataFrame(rows, columns=["text", "error"], dtype=object)


NOT_READ, NOT_UTF8 = "files of this kind aren't read", "not UTF-8"


def read_bytes(name: str, data: bytes, lenient: bool = False) -> tuple[str | None, str | None]:
    """The text of one file, or why there is none: what parsed() gives, for a reader that isn't a plan."""
    stem = name.rsplit("/", 1)[-1]
    ending = stem.rpartition(".")[2].lower() if "." in stem else ""
    if ending in (LENIENT_TEXT if lenient else TEXT) or lenient and stem.isascii() and stem.isdigit():
        try:
            return data.decode(), None
        except UnicodeDecodeError:
            return (data.decode("latin-1"), None) if lenient else (None, NOT_UTF8)
    if ending not in OFFICE:
        return None, NOT_READ
    return _read_office(data, "lenient pdf" if lenient and ending == "pdf" else ending)


def parsed(files: DataFrame, lenient: bool = False) -> DataFrame:
    """files (path, content, ...) with content as text, null where error says why; files of kinds that aren't read fail, too."""
    k = F.col("kind")
    raw, path = F.col("content"), F.col("path")
    pdf = F.when(F.lit(lenient) & (k == "pdf"), F.lit("lenient pdf")).otherwise(k)
    rows = files.withColumn("kind", kind(path, lenient)).withColumn("office", office_text(F.when(~k.isin("text", ""), raw), pdf))
    fine = F.is_valid_utf8(raw.cast("string")) | F.lit(lenient)
    text = F.when(k == "text", F.when(fine, decode(raw, lenient))).otherwise(F.col("office.text"))
    error = F.when(k == "", F.lit(NOT_READ)).when(k == "text", F.when(~fine, F.lit(NOT_UTF8))).otherwise(F.col("office.error"))
    return rows.withColumn("error", error).withColumn("content", text).drop("office", "kind")


def read_files(spark: SparkSession, folder: str, recursive: bool = False, lenient: bool = False) -> DataFrame:
    """(filename, content, error) of all files of a folder; names are relative when recursive, and those that begin with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = file_name(F.col("path"))
    if recursive:
        files = files.where(~F.startswith(name, F.lit(".")))
    root = folder.rstrip("/").split("://")[-1] + "/"
    shown = F.substring_index(F.col("path"), root, -1) if recursive else name
    return parsed(files.select("path", "content"), lenient).select(shown.alias("filename"), "content", "error")


def load_documents(spark: SparkSession, folder: str, recursive: bool = False, lenient: bool = False) -> DataFrame:
    """(filename, content) of the files that could be read and aren't empty, by name."""
    rows = read_files(spark, folder, recursive, lenient).where("error IS NULL")
    return rows.select("filename", "content").where(F.regexp_replace("content", r"(?U)\s", "") != "").orderBy("filename")


def write_counted(rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
    """Write rows, and return counts taken as they pass, in the same job; `rows` is how many there were."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]))
    return seen.get


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_params(spark: SparkSession, path: str) -> dict:
    """A JSON object; {} where there is no file."""
    if not exists(spark, path):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(params, sort_keys=True, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """One CSV file with a header; metric tables are a few rows."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """(role, content) of a JSON list of turns; no rows where there is no file."""
    schema = "role string, content string"
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_document(spark: SparkSession, folder: str, name: str, identity_name: str = "identity.md") -> DataFrame:
    """(filename, content) of one document, the text that sets the answering role with its heading; no row for a name that isn't there or isn't read."""
    path = f"{folder.rstrip('/')}/{name}"
    if "/" in name or not exists(spark, path):
        return spark.createDataFrame([], "filename string, content string")
    rows = load_documents(spark, path, lenient=True)
    return rows.withColumn("content", identity(F.col("content"))) if name == identity_name else rows
