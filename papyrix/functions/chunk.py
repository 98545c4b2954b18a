"""Passages: byte spans of a normalised text, packed from paragraphs and cut at sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Fixed values, in bytes: what packing aims at, the longest paragraph left whole, the shortest last passage.
TARGET, LONGEST, SHORTEST = 1200, 2000, 200
SPANS = "array<struct<start:int,end:int>>"


def paragraphs(text: bytes) -> list[tuple[int, int]]:
    """Spans between double line feeds; a third line feed belongs to the paragraph after it."""
    out, start = [], 0
    while start < len(text):
        end = text.find(b"\n\n", start)
        end = len(text) if end < 0 else end
        if end > start:
            out.append((start, end))
        start = end + 2
    return out


def cut_paragraph(text: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """A long paragraph by sentence ends in the back half of each window, else at its last space, else anywhere."""
    out = []
    while end - start > LONGEST:
        limit, half = start + LONGEST, start + LONGEST // 2
        # A sentence ends at a mark before a blank; the cut comes after the blank.
        ends = [m.start() for m in re.finditer(rb"[.!?\n](?=[ \n])", text[half + 1 : limit + 1])]
        if ends:
            at = half + 1 + ends[-1] + 2
        else:
            space = text.rfind(b" ", start, limit)
            at = limit if space < 0 else space + 1
        out.append((start, at))
        start = at
    if start < end:
        out.append((start, end))
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Byte spans of the passages of ``text``: none for a blank one, no overlap, a short last one joined to the one before."""
    raw = text.encode()
    if not text.strip():
        return []
    out: list[tuple[int, int]] = []
    open_at: tuple[int, int] | None = None
    for start, end in paragraphs(raw):
        if end - start > LONGEST:
            out += [open_at] if open_at else []
            open_at = None
            out += cut_paragraph(raw, start, end)
        elif open_at and end - open_at[0] > TARGET:
            out.append(open_at)
            open_at = (start, end)
        else:
            open_at = (open_at[0] if open_at else start, end)
    out += [open_at] if open_at else []
    if len(out) > 1 and len(raw[slice(*out[-1])].strip(b"\n ")) < SHORTEST:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def _spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b} for a, b in spans(t or "")])


def passage_spans(text: Column) -> Column:
    return F.pandas_udf(_spans, SPANS)(text)


def chunks(documents: DataFrame) -> DataFrame:
    """Passages of ``documents`` (id, source, text): one row each, with offsets before trimming and the trimmed text.

    Texts are sliced before passages become rows, so that no passage's row carries the whole text."""
    rows = documents.select(F.col("id").alias("doc_id"), "source", F.col("text").cast("binary").alias("whole"), passage_spans(F.col("text")).alias("spans"))
    slices = let(F.col("whole"), lambda raw: F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(raw, s["start"] + 1, s["end"] - s["start"]).alias("raw"))))
    rows = rows.select("doc_id", "source", F.posexplode(slices).alias("index", "span"))
    # A cut within a character leaves the replacement character on either side.
    text = F.btrim(F.make_valid_utf8(F.col("span.raw").cast("string")), F.lit("\n "))
    return rows.select(
        F.concat("doc_id", F.lit("#"), F.col("index").cast("string")).alias("id"), "doc_id", "source", "index", F.col("span.start").alias("start"), F.col("span.end").alias("end"), text.alias("text"),
    ).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
