"""Files as segments and back: text, CSV, XLSX and DOCX, word lists, dictionaries and the lookup."""

from __future__ import annotations

import csv
import io
import marshal
import posixpath
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, islice
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import runs
from ..schema import SEGMENTS

FORMATS = ("txt", "csv", "xlsx", "docx")
#: What Spark says of a path that isn't there.
MISSING = "PATH_NOT_FOUND"
Row = tuple[str | None, int, list[str]]
#: Bytes of a file that are one row on their way to Python, rows of cells that go back at once.
CHUNK, LINES = 4 << 20, 4096

# ---- parsing one file's bytes into (sheet, row, cells) ----------------------------------------------------------


def read_csv(file: IO[bytes]) -> Iterator[Row]:
    text = io.TextIOWrapper(file, encoding="utf-8", newline="")
    yield from ((None, i, row) for i, row in enumerate(csv.reader(text)))
    text.detach()


def _xml(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _nodes(book: zipfile.ZipFile, name: str, tag: str, parent: str | None = None) -> Iterator[ElementTree.Element]:
    """Elements of a part in order, each taken out of the tree when it has been read."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        path: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            above = _local(path[-1].tag) if path else None
            if _local(node.tag) == tag and parent in (None, above):
                yield node
                if path:
                    path[-1].remove(node)
            elif parent is not None and above == parent:
                path[-1].remove(node)


def read_xlsx(file: IO[bytes]) -> Iterator[Row]:
    """All sheets in the workbook's order; cached values as text, missing cells empty. A sheet's rows wait on disk for its width."""
    if file.read(4) != b"PK\x03\x04":
        raise ValueError("the workbook is encrypted or damaged")
    with zipfile.ZipFile(file) as book:
        shared = [_texts(s) for s in _nodes(book, "xl/sharedStrings.xml", "si")]
        targets = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
        for sheet in (n for n in _xml(book, "xl/workbook.xml").iter() if _local(n.tag) == "sheet"):
            target = next(targets[v] for k, v in sheet.attrib.items() if _local(k) == "id")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            with tempfile.TemporaryFile() as held:
                wide, n = 0, 0
                for n, node in enumerate(_nodes(book, part, "row"), 1):
                    cells = _xlsx_cells(node, shared)
                    wide = max(wide, len(cells))
                    marshal.dump(cells, held)
                held.seek(0)
                for i in range(n):
                    cells = marshal.load(held)
                    yield sheet.get("name"), i, cells + [""] * (wide - len(cells))


def _xlsx_cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    cells: list[str] = []
    for cell in row:
        letters = re.match(r"[A-Z]+", cell.get("r", "")) if cell.get("r") else None
        at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
        cells += [""] * (at - len(cells))
        value = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
        kind = cell.get("t")
        cells.append(shared[int(value)] if kind == "s" and value else _texts(cell) if kind == "inlineStr" else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value)
    return cells


def read_docx(file: IO[bytes]) -> Iterator[Row]:
    """The body's own paragraphs; tables, headers and footers aren't read."""
    with zipfile.ZipFile(file) as book:
        yield from ((None, 0, [_texts(p)]) for p in _nodes(book, "word/document.xml", "p", "body"))


READERS: dict[str, Callable[[IO[bytes]], Iterator[Row]]] = {"csv": read_csv, "xlsx": read_xlsx, "docx": read_docx}


def parse_csv(raw: bytes) -> list[Row]:
    return list(read_csv(io.BytesIO(raw)))


def parse_xlsx(raw: bytes) -> list[Row]:
    return list(read_xlsx(io.BytesIO(raw)))


def parse_docx(raw: bytes) -> list[Row]:
    return list(read_docx(io.BytesIO(raw)))


# ---- sources ------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path. However many small ones there are, tasks stay as many as a shuffle has: Spark alone makes one for a handful."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = spark.read.format("binaryFile").load(path).coalesce(tasks)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("source_file"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("source_format"), "content")


def read_files(spark: SparkSession, path: str, others: str = "error") -> DataFrame:
    """Segments of all files under a path, by their suffix. Files of another suffix are an error, or with others="skip" left out.

    Text is cut inside the JVM; other files reach Python in chunks, are put together on its disk and read from there row by row.
    Contents are read for the formats that are there alone.
    """
    files = _files(spark, path)
    there = {r[0] for r in files.select(F.when(F.col("source_format").isin(*FORMATS), F.col("source_format")).otherwise("").alias("kind")).distinct().collect()}
    if "" in there and others != "skip":
        raise ValueError(f"Unsupported file format: {files.filter(~F.col('source_format').isin(*FORMATS)).select('source_file').first()[0]}")
    parts = []
    if "txt" in there:
        lines = files.filter("source_format = 'txt'").select("path", "source_file", "source_format", F.posexplode(T.lines(F.decode("content", "UTF-8"))).alias("pos", "line"))
        cell = F.struct(F.col("line").alias("text"), F.lit(None).cast("string").alias("sheet_name"), F.lit(0).alias("row_index"), F.lit(0).alias("col_index"))
        parts.append(lines.select(F.col("path").alias("doc_id"), "source_file", "source_format", (F.col("pos") + 1).alias("line_number"), F.lit(False).alias("is_subline"), F.lit(0).alias("sub_index"), F.array(cell).alias("cells")))
    if there & set(READERS):
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length("content") / CHUNK).cast("int")), lambda i: F.substr("content", i * CHUNK + 1, F.lit(CHUNK)))
        rows = files.filter(F.col("source_format").isin(*READERS)).select("path", "source_file", "source_format", F.posexplode_outer(chunks).alias("pos", "chunk"))
        parts.append(rows.mapInArrow(_segments, SEGMENTS))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SEGMENTS)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of files that come as chunks in their order."""
    held, name = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            if batch["pos"][i].as_py() == 0:
                if held:
                    yield from _parsed(held, *name)
                held, name = tempfile.TemporaryFile(), [batch[c][i].as_py() for c in ("path", "source_file", "source_format")]
            held.write(batch["chunk"][i].as_buffer())
    if held:
        yield from _parsed(held, *name)


def _parsed(file: IO[bytes], path: str, source: str, kind: str) -> Iterator[pa.RecordBatch]:
    with file:
        file.seek(0)
        rows, first = READERS[kind](file), 1
        while lines := list(islice(rows, LINES)):
            n, sizes = len(lines), [len(cells) for _, _, cells in lines]
            cells = {
                "text": pa.array([t for _, _, cells in lines for t in cells], pa.string()),
                "sheet_name": pa.array([sheet for sheet, _, cells in lines for _ in cells], pa.string()),
                "row_index": pa.array([i for _, i, cells in lines for _ in cells], pa.int32()),
                "col_index": pa.array([c for size in sizes for c in range(size)], pa.int32()),
            }
            listed = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays(list(cells.values()), list(cells)))
            same = lambda value, kind_: pa.array([value] * n, kind_)
            yield pa.RecordBatch.from_arrays(
                [same(path, pa.string()), same(source, pa.string()), same(kind, pa.string()), pa.array(range(first, first + n), pa.int32()), same(False, pa.bool_()), same(0, pa.int32()), listed],
                ["doc_id", "source_file", "source_format", "line_number", "is_subline", "sub_index", "cells"],
            )
            first += n


def preview(segments: DataFrame, rows: int = 3) -> DataFrame:
    """Header and the first rows of each document, with a suggested category for each header."""
    head = segments.filter(F.col("line_number") <= rows + 1).select("doc_id", "line_number", F.posexplode(F.transform("cells", lambda c: c["text"])).alias("col_index", "text"))
    named = head.filter("line_number = 1").select("doc_id", "col_index", F.col("text").alias("header"), T.suggest_category("text").alias("category"))
    samples = head.filter("line_number > 1").groupBy("doc_id", "col_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda s: s["text"]).alias("samples"))
    return named.join(samples, ["doc_id", "col_index"], "left")


def read_custom_lists(spark: SparkSession, path: str) -> list[dict]:
    """Lists of a JSON file; a missing or damaged one has none. They are typed in by hand, so they fit the driver."""
    try:
        raw = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != MISSING:
            raise
        return []
    schema = "struct<lists:array<struct<name:string,category:string,words:array<string>>>>"
    row = spark.createDataFrame([(raw[0] if raw else "",)], "t string").select(F.from_json("t", schema, {"mode": "PERMISSIVE"}).alias("j")).first()
    return [x.asDict() for x in (row["j"]["lists"] or [])] if row and row["j"] else []


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Words (lower case) of a file with one on each line; a missing file is an empty dictionary."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != MISSING:
            raise
        return spark.createDataFrame([], "word string")
    return lines.select(F.lower("value").alias("word")).filter(F.trim("word") != "").distinct()


def words_of(names: DataFrame, column: str) -> DataFrame:
    """The words (word) of names of several words, such as countries."""
    return names.select(F.explode(F.split(column, r"(?U)[^\w'-]+")).alias("word"))


def build_dictionary(words: DataFrame, others: list[DataFrame], min_length: int = 3) -> DataFrame:
    """Distinct words of all tables (word), lower case, of at least min_length letters."""
    for other in others:
        words = words.select("word").union(other.select("word"))
    return words.select(F.lower(F.trim("word")).alias("word")).filter(F.length("word") >= min_length).distinct()


# ---- sinks ----------------------------------------------------------------------------------------------------


_TYPES, _RELS = "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_BODY = "application/vnd.openxmlformats-officedocument"


def _package(main: str, kind: str, more: str = "") -> dict[str, str]:
    return {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{main}" ContentType="{_BODY}.{kind}.main+xml"/>{more}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


def _safe(text: str) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text))


class _Text:
    """A file of lines; what comes goes to the stream at once."""

    def __init__(self, out: IO[bytes]):
        self.out = out

    def line(self, sheet: str | None, cells: list[str]) -> None:
        self.out.write((" | ".join(cells) + "\n").encode("utf-8"))

    def close(self) -> None:
        pass


class _Csv(_Text):
    def line(self, sheet: str | None, cells: list[str]) -> None:
        text = io.StringIO(newline="")
        csv.writer(text).writerow(cells)
        self.out.write(text.getvalue().encode("utf-8"))


class _Book:
    """A zip of XML parts. Bodies of sheets or paragraphs wait on this machine's disk until the file is whole."""

    def __init__(self, out: IO[bytes]):
        self.out, self.bodies = out, {}

    def line(self, sheet: str | None, cells: list[str]) -> None:
        sheet = self.name(sheet)
        if sheet not in self.bodies:
            self.bodies[sheet] = tempfile.TemporaryFile()
        self.bodies[sheet].write(self.body(cells).encode("utf-8"))

    def close(self) -> None:
        with tempfile.TemporaryFile() as made:
            with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as book:
                for name, parts in self.parts().items():
                    info = zipfile.ZipInfo(name)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    with book.open(info, "w", force_zip64=True) as part:
                        part.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n')
                        for x in parts:
                            if isinstance(x, str):
                                part.write(x.encode("utf-8"))
                            else:
                                x.seek(0)
                                shutil.copyfileobj(x, part, CHUNK)
                                x.close()
            made.seek(0)
            shutil.copyfileobj(made, self.out, CHUNK)


class _Xlsx(_Book):
    def name(self, sheet: str | None) -> str:
        return sheet or "Sheet"

    def body(self, cells: list[str]) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_safe(t)}</t></is></c>' for t in cells) + "</row>"

    def parts(self) -> dict[str, list]:
        sheets = self.bodies or {"Sheet": ""}
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        more = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_BODY}.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        parts = {name: [body] for name, body in _package("xl/workbook.xml", "spreadsheetml.sheet", more).items()}
        parts["xl/workbook.xml"] = [f'<workbook xmlns="{ns}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{_safe(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>"]
        parts["xl/_rels/workbook.xml.rels"] = [f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"]
        for i, body in enumerate(sheets.values(), 1):
            parts[f"xl/worksheets/sheet{i}.xml"] = [f'<worksheet xmlns="{ns}"><sheetData>', body, "</sheetData></worksheet>"]
        return parts


class _Docx(_Book):
    def name(self, sheet: str | None) -> str:
        return "body"

    def body(self, cells: list[str]) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{_safe(" | ".join(cells))}</w:t></w:r></w:p>'

    def parts(self) -> dict[str, list]:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        parts = {name: [body] for name, body in _package("word/document.xml", "wordprocessingml.document").items()}
        parts["word/document.xml"] = [f'<w:document xmlns:w="{ns}"><w:body>', self.bodies.get("body", ""), "</w:body></w:document>"]
        return parts


WRITERS = {"txt": _Text, "csv": _Csv, "xlsx": _Xlsx, "docx": _Docx}


def _rendered(kind: str, lines: list[list[dict]]) -> bytes:
    out = io.BytesIO()
    writer = WRITERS[kind](out)
    for cells in lines:
        writer.line(cells[0]["sheet_name"] if cells else None, [c["text"] or "" for c in cells])
    writer.close()
    return out.getvalue()


def render_xlsx(lines: list[list[dict]]) -> bytes:
    return _rendered("xlsx", lines)


def render_docx(lines: list[list[dict]]) -> bytes:
    return _rendered("docx", lines)


def _starts(keys: list[pa.Array]) -> list[int]:
    """Rows at which a run of equal keys begins."""
    n = len(keys[0])
    new = {i + 1 for key in keys for i in pc.indices_nonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1))).to_pylist()}
    return sorted({0} | new) if n else []


def _bytes(lines: pa.StringArray) -> pa.Buffer:
    """The bytes of strings that follow each other, as they lie in memory."""
    wide = pa.types.is_large_string(lines.type)
    offsets = memoryview(lines.buffers()[1]).cast("q" if wide else "i")
    first, last = offsets[lines.offset], offsets[lines.offset + len(lines)]
    return lines.buffers()[2].slice(first, last - first)


def write_files(segments: DataFrame, uri: str, output_format: str = "preserve_format") -> None:
    """Each document as a file {stem}_anon.{suffix} in a folder that all executors reach; a retried task writes the same bytes again.

    Lines are sorted inside the JVM and written as they come, so a file may be of any size. Those of text files are joined there too
    and written run by run, not one by one.
    """
    kind = F.col("source_format") if output_format == "preserve_format" else F.lit("txt")
    name = F.concat(F.regexp_replace("source_file", r"[.][^.]*$", ""), F.lit("_anon."), kind)
    texts, plain = F.transform("cells", lambda c: F.coalesce(c["text"], F.lit(""))), kind == "txt"
    lines = segments.select(
        "doc_id", "source_file", kind.alias("kind"), name.alias("file_name"), "line_number", "sub_index", F.get("cells", F.lit(0))["sheet_name"].alias("sheet"),
        F.when(plain, F.concat(F.array_join(texts, " | "), F.lit("\n"))).otherwise("").alias("line"), F.when(~plain, texts).alias("texts"),
    )
    keys = ["doc_id", "source_file", "kind"]
    lines = lines.repartition(*keys).sortWithinPartitions(*keys, "line_number", "sub_index")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        key = writer = out = None
        for batch in runs(batches, LINES):
            starts = _starts([batch[c] for c in keys])
            for at, stop in zip(starts, [*starts[1:], batch.num_rows]):
                found = tuple(batch[c][at].as_py() for c in keys)
                if key != found:
                    if out:
                        writer.close()
                        out.close()
                    key, out = found, system.open_output_stream(f"{folder}/{batch['file_name'][at].as_py()}", buffer_size=1 << 16)
                    writer = WRITERS[key[2]](out)
                part = batch.slice(at, stop - at)
                if key[2] == "txt":
                    out.write(_bytes(part["line"]))
                    continue
                for sheet, texts in zip(part["sheet"].to_pylist(), part["texts"].to_pylist()):
                    writer.line(sheet, texts)
        if out:
            writer.close()
            out.close()
        return iter(())

    lines.mapInArrow(put, "done boolean").write.format("noop").mode("overwrite").save()


def write_lookup(lookup: DataFrame, path: str) -> None:
    """The lookup as one CSV in the order of first sight."""
    rows = lookup.orderBy("scope", "order").select("original_term", "anonymised_term", "pii_category", F.col("first_seen_doc").alias("source_file"), "first_seen_line")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
