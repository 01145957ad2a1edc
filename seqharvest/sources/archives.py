"""Files inside zip archives: workbooks as tables of cells, and delimited members as text fields.

An archive's directory stands at its end, so an archive is read whole by one task; its
members are streamed from it, and what they hold goes on in small batches.  A sheet of a workbook has at most
1,048,576 rows by its format.  Everything after the cells (shared strings, headers, rows) is done by joins and groups.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a member that are parsed at once, and rows of a batch.
READ, BATCH = 1 << 16, 10_000
# Names in the workbook format.
SHEET = re.compile(r"xl/worksheets/[^/]+\.xml")
STRINGS = "xl/sharedStrings.xml"


def _column(reference: str) -> int:
    """The number of a cell's column from the letters of its reference, A is 1."""
    letters = reference.rstrip("0123456789").upper()
    return sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters)))


class _Reader:
    """Events of one XML member: what each cell, or each shared string, holds."""

    def __init__(self, unit: str):
        self.unit, self.row, self.column, self.kind = unit, 0, 0, ""
        self.text: list[str] | None = None  # parts of the open unit
        self.takes = self.aside = 0  # open elements that hold text, and phonetic ones, which don't count
        self.found: list[tuple[int, int, str, str]] = []
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._open, self._close, self._data

    def _open(self, name: str, given: dict[str, str]) -> None:
        tag = name.rpartition(" ")[2]
        if tag == "row":
            self.row, self.column = int(given.get("r", self.row + 1)), 0
        elif tag == self.unit:
            # a cell without a reference follows the one before it; so does every shared string
            self.column = _column(given["r"]) if "r" in given else self.column + 1
            self.kind, self.text = given.get("t", "n"), []
        elif tag == "rPh":
            self.aside += 1
        elif tag in ("v", "t"):
            self.takes += 1

    def _close(self, name: str) -> None:
        tag = name.rpartition(" ")[2]
        if tag == self.unit:
            self.found.append((self.row, self.column, self.kind, "".join(self.text)))
            self.text = None
        elif tag == "rPh":
            self.aside -= 1
        elif tag in ("v", "t"):
            self.takes -= 1

    def _data(self, text: str) -> None:
        if self.text is not None and self.takes and not self.aside:
            self.text.append(text)

    def read(self, stream) -> Iterator[tuple[int, int, str, str]]:
        while part := stream.read(READ):
            self.parser.Parse(part)
            yield from self.found
            self.found.clear()
        self.parser.Parse(b"", True)
        yield from self.found


def _members(spark: SparkSession, path: str, wanted, rows_of, schema: str) -> DataFrame:
    """Rows (file, member, ...) of the members of archives whose name meets ``wanted``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in sorted(filter(wanted, archive.namelist())):
                        with archive.open(member) as stream:
                            held = []
                            for row in rows_of(stream):
                                held.append((file, member, *row))
                                if len(held) == BATCH:
                                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)
                                    held = []
                            if held:
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, column, value) of all sheets of workbooks; empty cells are left out."""
    found = _members(spark, path, SHEET.fullmatch, lambda s: _Reader("c").read(s), "file string, sheet string, row long, column long, kind string, value string")
    strings = _members(spark, path, STRINGS.__eq__, lambda s: ((column - 1, text) for _, column, _, text in _Reader("si").read(s)), "file string, member string, at long, text string")
    shared = found.where("kind = 's'").withColumn("at", F.col("value").try_cast("long")).join(strings.drop("member"), ["file", "at"])
    plain = found.where("kind != 's'")
    every = plain.drop("kind").unionByName(shared.select("file", "sheet", "row", "column", F.col("text").alias("value")))
    return every.where("value != ''")


def read_workbook(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows below each sheet's header, as text columns of these names.  A header is a sheet's first row that holds all of them."""
    every = cells(spark, path)
    names = every.where(F.col("value").isin(columns))
    whole = names.groupBy("file", "sheet", "row").agg(F.countDistinct("value").alias("n")).where(F.col("n") == len(set(columns)))
    first = whole.groupBy("file", "sheet").agg(F.min("row").alias("header"))
    header = names.join(first, ["file", "sheet"]).where("row = header")
    header = header.groupBy("file", "sheet", "header", F.col("value").alias("name")).agg(F.min("column").alias("column"))
    below = every.join(header, ["file", "sheet", "column"]).where("row > header")
    pick = [F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns]
    return below.groupBy("file", "sheet", "row").agg(*pick).select(*columns)


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of the CSV members of archives, by each member's own header; a record is a line."""

    def lines(stream) -> Iterator[tuple[int, str]]:
        for n, line in enumerate(io.TextIOWrapper(stream, "utf-8-sig", newline="")):
            if line := line.rstrip("\r\n"):
                yield n, line

    text = _members(spark, path, lambda n: n.lower().endswith(".csv"), lines, "file string, member string, n long, line string")
    first = text.where("n = 0").select("file", "member", F.col("line").alias("header"))
    rows = text.where("n > 0").join(first, ["file", "member"])
    # headers may differ: a field is found by its name's place
    width = F.size(F.split("header", ","))
    most = rows.agg(F.max(width)).first()[0] or 1
    fields = F.from_csv("line", ", ".join(f"f{i} string" for i in range(most)))
    listed = F.array(*[fields[f"f{i}"] for i in range(most)])
    place = lambda c: F.array_position(F.split("header", ","), c)
    return rows.select(*[F.when(place(c) > 0, F.get(listed, (place(c) - 1).cast("int"))).alias(c) for c in columns])
