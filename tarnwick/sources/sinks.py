"""Writers. Output goes to directories and replaces what was there."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header and a fixed order of fields; absent fields are empty."""
    df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]).write.mode("overwrite").csv(path, header=True)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def json_document(df: DataFrame, path: str) -> None:
    """The one row of ``df``, with its nested structs and arrays, as one JSON document."""
    if df.limit(2).count() != 1:
        raise ValueError("a document is made of one row")
    df.coalesce(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def text_list(df: DataFrame, column: str, path: str) -> None:
    """One value a line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def with_summary(rows: DataFrame, summaries: list[DataFrame]) -> DataFrame:
    """``rows`` with summary rows below; columns that a side lacks are null."""
    for summary in summaries:
        rows = rows.unionByName(summary, allowMissingColumns=True)
    return rows


def _safe(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _card(title: str, text: str) -> Column:
    return F.concat(F.lit("<div><h3>"), _safe(F.col(title)), F.lit("</h3><p>"), _safe(F.col(text)), F.lit("</p></div>"))


def html_card_rows(rows: DataFrame, title: str, text: str, by: str) -> DataFrame:
    """(by, title, html): a card for each row, special characters escaped; no group is gathered.

    A writer partitioned by ``by`` and sorted by title puts the cards of a section together.
    """
    return rows.select(by, F.coalesce(title, F.lit("")).alias("title"), _card(title, text).alias("html"))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG file of 8-bit red, green and blue rows."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_files(rasters: DataFrame) -> DataFrame:
    """(name, content): the PNG file of each raster (name, width, height, rgb)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [png(w, h, bytes(rgb)) for w, h, rgb in zip(batch["width"], batch["height"], batch["rgb"])]})

    return rasters.select("name", "width", "height", "rgb").mapInPandas(run, "name string, content binary")


def write_pngs(rasters: DataFrame, folder: str) -> None:
    """One file for each row, written by the tasks into a mounted folder that all of them share.

    Each task writes under a name of its own and renames the file, so a task that runs twice leaves one whole file.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("the tasks must share a mounted folder; elsewhere write the table png_files(...)")
    base = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(base, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                own = os.path.join(base, f".{uuid.uuid4().hex}")
                with open(own, "wb") as out:
                    out.write(content)
                os.replace(own, os.path.join(base, f"{name}.png"))
            yield pd.DataFrame({"name": batch["name"]})

    png_files(rasters).mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
