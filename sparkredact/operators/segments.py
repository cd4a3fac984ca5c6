"""Documents as lines of cells, and lines cut to a length and joined again."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import runs
from ..schema import SEGMENTS

CELL_JOIN = " | "


def segments_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_format: str = "txt") -> DataFrame:
    """A segment for each line of each text."""
    line = F.posexplode(T.lines(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "line")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), line)
    cell = F.struct(F.col("line").alias("text"), F.lit(None).cast("string").alias("sheet_name"), F.lit(0).alias("row_index"), F.lit(0).alias("col_index"))
    return rows.select("doc_id", F.col("doc_id").alias("source_file"), F.lit(source_format).alias("source_format"), (F.col("pos") + 1).alias("line_number"), F.lit(False).alias("is_subline"), F.lit(0).alias("sub_index"), F.array(cell).alias("cells"))


def segments_of_rows(rows: DataFrame, doc_id: str, order_by: str, columns: list[str], header: bool = True) -> DataFrame:
    """A table as one document: line 1 is the header, every row in the order of a unique integer column is a line of cells."""
    cells = lambda values: F.array(*[F.struct(v.alias("text"), F.lit(None).cast("string").alias("sheet_name"), F.col("line").cast("int").alias("row_index"), F.lit(i).alias("col_index")) for i, v in enumerate(values)])
    body = rows.select((F.col(order_by) + (1 if header else 0)).cast("int").alias("line"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    body = body.select("line", cells([F.col(c) for c in columns]).alias("cells"))
    if header:
        top = rows.sparkSession.range(1).select(F.lit(1).alias("line")).select("line", cells([F.lit(c) for c in columns]).alias("cells"))
        body = top.unionByName(body)
    return body.select(F.lit(doc_id).alias("doc_id"), F.lit(doc_id).alias("source_file"), F.lit("csv").alias("source_format"), F.col("line").alias("line_number"), F.lit(False).alias("is_subline"), F.lit(0).alias("sub_index"), "cells")


def line_text(cells: str = "cells"):
    return F.array_join(F.transform(F.col(cells), lambda c: F.coalesce(c["text"], F.lit(""))), CELL_JOIN)


def cut(text: str, most: int) -> list[str]:
    """Whole sentences, as many as fit; what is longer is cut at its last space, or where it must be."""
    out, held = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        joined = f"{held} {sentence}".strip() if held else sentence
        if held and len(held) + 1 + len(sentence) > most:
            out.append(held)
            joined = sentence
        held = joined
    pieces = []
    for piece in [*out, held] if held else out:
        while len(piece) > most:
            at = piece.rfind(" ", 0, most)
            at = most if at < 0 else at
            pieces.append(piece[:at])
            piece = piece[at:].lstrip()
        if piece:
            pieces.append(piece)
    return pieces


def _packed(cells: list[dict], most: int) -> list[list[dict]]:
    groups: list[list[dict]] = []
    size = 0
    for cell in cells:
        n = len(cell["text"])
        if groups and size + len(CELL_JOIN) + n <= most:
            groups[-1].append(cell)
            size += len(CELL_JOIN) + n
        else:
            groups.append([cell])
            size = n
    plain = lambda t: {"text": t, "sheet_name": None, "row_index": 0, "col_index": 0}
    return [g for group in groups for g in ([[plain(t)] for t in cut(group[0]["text"], most)] if len(group) == 1 and len(group[0]["text"]) > most else [group])]


def split_long_lines(segments: DataFrame, max_chars: int = 500) -> DataFrame:
    """Lines of more than max_chars become sublines of at most that; short ones never leave the JVM."""
    long_line = F.length(line_text()) > max_chars

    def split(batches):
        for batch in runs(batches):
            at, index, out = [], [], []
            for row, cells in enumerate(batch["cells"].to_pylist()):
                parts = _packed(cells, max_chars) if len(cells) > 1 else [[{**cells[0], "text": t, "sheet_name": None, "row_index": 0, "col_index": 0}] for t in cut(cells[0]["text"], max_chars)]
                at += [row] * len(parts)
                index += range(len(parts))
                out += parts
            rows = batch.take(pa.array(at, pa.int32()))
            new = {"cells": pa.array(out, batch.schema.field("cells").type), "sub_index": pa.array(index, pa.int32()), "is_subline": pa.array([i > 0 for i in index], pa.bool_())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else rows[c] for c in batch.schema.names], batch.schema.names)

    return segments.filter(~long_line).unionByName(segments.filter(long_line).mapInArrow(split, SEGMENTS))


def reunify_sublines(segments: DataFrame) -> DataFrame:
    """Sublines of one line become one line again, their cells in order."""
    part = F.struct("sub_index", "cells")
    whole = segments.groupBy("doc_id", "source_file", "source_format", "line_number").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select("doc_id", "source_file", "source_format", "line_number", F.lit(False).alias("is_subline"), F.lit(0).alias("sub_index"), F.flatten(F.transform("parts", lambda p: p["cells"])).alias("cells"))
