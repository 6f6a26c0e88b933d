"""Uploaded sheets: CSV and XLSX as DataFrames of strings, and the column that holds the URLs."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from lodestack.functions.text import strip
from lodestack.settings import DEFAULTS

EXCEL = (".xlsx", ".xlsm")
TEXTS = (".csv", ".txt", ".tsv")
HEAD_BYTES = 65536
#: A value that is an absolute URL, and headers that announce URLs (fixed patterns).
URL_VALUE = r"(?i)^https?://\S+$"
URL_HEADER = re.compile(r"(^|[^a-z])(url|link|website|web|site|profile|page|href)([^a-z]|$)", re.I)


class SheetError(ValueError):
    """The file cannot be read as a sheet at all."""


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding) by the first of the encodings sheets are saved in that fits."""
    for name in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8"


def sniff_delimiter(head: str, suffix: str = ".csv") -> str:
    if suffix == ".tsv":
        return "\t"
    try:
        return csv.Sniffer().sniff(head[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def unique_headers(cells: list[str]) -> list[str]:
    """Header names made unique; blanks become column_i. A later literal `a_1` never collides with a made one."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = base = c.strip() or f"column_{i}"
        n = 0
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def _tidy(df: DataFrame) -> DataFrame:
    """Trimmed cells, "" for missing ones, rows without any value dropped."""
    df = df.select(*[F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    return df.filter(F.exists(F.array(*[F.col(f"`{c}`") for c in df.columns]), lambda x: x != ""))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited sheet with every cell a string. Only the file's head is read by the driver, to sniff it."""
    suffix = PurePosixPath(path).suffix.lower()
    raw = spark.read.format("binaryFile").load(path).select(F.substring(F.col("content"), 1, HEAD_BYTES).alias("h")).first()
    if raw is None or not bytes(raw.h).strip():
        raise SheetError("The file is empty.")
    data = bytes(raw.h)
    if len(data) == HEAD_BYTES:  # do not cut a character in two
        data = data[: data.rfind(b"\n") + 1] or data
    head, encoding = decode(data)
    sep = delimiter or sniff_delimiter(head, suffix)
    first = next(csv.reader(io.StringIO(head, newline=""), delimiter=sep), [])
    names = unique_headers(first)
    schema = StructType([StructField(n, StringType()) for n in names])
    if encoding == "cp1252":  # the CSV reader has no such charset
        return _tidy(_read_small(spark, path, sep, schema))
    charset = "ISO-8859-1" if encoding == "latin-1" else "UTF-8"
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, quote='"', escape='"', encoding=charset, mode="PERMISSIVE", enforceSchema=True)
    return _tidy(df)


def _read_small(spark: SparkSession, path: str, sep: str, schema: StructType) -> DataFrame:
    """A sheet decoded by the driver; bound: uploads are refused beyond max_upload_bytes."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size > DEFAULTS.max_upload_bytes:
        raise SheetError(f"A sheet of {size} bytes must be UTF-8 or Latin-1.")
    text, _ = decode(bytes(spark.read.format("binaryFile").load(path).first().content))
    n = len(schema)
    rows = [tuple((r + [""] * n)[:n]) for r in list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))[1:]]
    return spark.createDataFrame(rows, schema)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def _number(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f.is_integer() and "e" not in v.lower() and "." not in v else str(f) if not f.is_integer() else str(int(f))


def xlsx_rows(data: bytes) -> list[list[str]]:
    """The non-blank rows of a workbook's active sheet, all cells as trimmed strings."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book = ET.fromstring(z.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise SheetError(f"could not open the workbook: {e}") from e
    sheets = book.findall("m:sheets/m:sheet", _NS)
    if not sheets:
        raise SheetError("The workbook has no sheets.")
    view = book.find("m:bookViews/m:workbookView", _NS)
    active = min(int(view.get("activeTab", 0)) if view is not None else 0, len(sheets) - 1)
    rid = sheets[active].get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == rid)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    sheet = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.findall("m:c", _NS)):
            kind, v = c.get("t"), c.find("m:v", _NS)
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                value = ""
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = "True" if v.text == "1" else "False"
            else:
                value = v.text if kind in ("str", "e") else _number(v.text)
            cells[_column(c.get("r")) if c.get("r") else i] = value.strip()
        line = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
        if any(line):
            rows.append(line)
    return rows


class _XlsxPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self):
        return [_XlsxPartition(self.path)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            rows = xlsx_rows(f.read())
        for r in rows[1:]:
            yield tuple((r + [""] * self.width)[: self.width])


class XlsxDataSource(DataSource):
    """`spark.read.format("xlsx").load(path)`: the active sheet, first row as header, all strings."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _path(self) -> str:
        return re.sub(r"^file:(//)?", "", self.options["path"])

    def schema(self) -> StructType:
        with open(self._path(), "rb") as f:
            rows = xlsx_rows(f.read())
        if not rows:
            raise SheetError("The first sheet is empty.")
        return StructType([StructField(n, StringType()) for n in unique_headers(rows[0])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self._path(), len(schema))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxDataSource)
    return _tidy(spark.read.format("xlsx").load(path))


def read_sheet(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A sheet by its suffix; other suffixes, .xls among them, are refused."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in EXCEL:
        return read_xlsx(spark, path)
    if suffix in TEXTS:
        return read_csv(spark, path, delimiter)
    raise SheetError(f"Unsupported file type '{suffix}'. Upload a .csv or .xlsx file.")


def url_column_scores(df: DataFrame) -> DataFrame:
    """pos, header, url_fraction, score of each string column, from one aggregation over the sheet."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]

    def share(c: str) -> Column:
        v = strip(F.coalesce(F.col(f"`{c}`"), F.lit("")))
        return F.try_divide(F.count_if(v.rlike(URL_VALUE)), F.count_if(v != ""))

    one = df.agg(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("header"), F.round(share(c), 6).alias("url_fraction"), F.lit(0.5 if URL_HEADER.search(c) else 0.0).alias("hint")) for i, c in enumerate(names)]).alias("a"))
    return one.select(F.explode("a").alias("x")).select("x.pos", "x.header", "x.url_fraction", (F.col("x.url_fraction") + F.col("x.hint")).alias("score"))


def detect_url_column(df: DataFrame) -> str | None:
    """The best column of which at least half the filled values are URLs; the first among equals."""
    best = url_column_scores(df).filter("url_fraction >= 0.5").orderBy(F.desc("score"), "pos").first()
    return best.header if best else None
