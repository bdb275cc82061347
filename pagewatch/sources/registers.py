"""Official registers and counts, as CSV and as HTML tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from pagewatch.functions import text as T

#: Cells that a publisher has left out. They are absent, never zero.
SUPPRESSED = ("--", "-", "", "n/a", "..")


def register_rows(rows: DataFrame, name: str, status: str | None = None, location: str | None = None, route: str | None = None, order: str = "pos") -> DataFrame:
    """One row per lower-case name: name, status and location as first given, distinct routes in the order seen.

    A named column that isn't there is an error: a register whose columns moved has to fail loudly. Blank names are left out.
    """
    for column in (name, status, location, route):
        if column is not None and column not in rows.columns:
            raise ValueError(f"no column named {column!r} in the register; columns are {rows.columns}")

    def cell(x: str | None) -> Column:
        return F.nullif(F.trim(x), F.lit("")) if x else F.lit(None).cast("string")

    own = rows.select(cell(name).alias("name"), cell(status).alias("status"), cell(location).alias("location"), cell(route).alias("route"), order).where("name is not null")
    first = F.min_by(F.struct("name", "status", "location"), order).alias("first")
    seen = F.sort_array(F.collect_list(F.when(F.col("route").isNotNull(), F.struct("at", "route")))).alias("routes")
    # Routes shrink to one row each before they are gathered.
    per = own.groupBy(F.lower("name").alias("key"), "route").agg(F.min(order).alias("at"), first)
    out = per.groupBy("key").agg(F.min_by("first", "at").alias("first"), seen, F.min("at").alias("pos"))
    return out.select("key", "first.name", "first.status", "first.location", F.col("routes.route").alias("routes"), "pos")


def read_csv(spark: SparkSession, path: str, sep: str = ",", lines: bool = False) -> DataFrame:
    """A published CSV with a header, all as strings, with pos and corrupt. pos: file, place of the split in it, row within; it orders rows as they stand in files that are
    ordered by their names, however the files are split.

    corrupt is the line as it stands where it has more or fewer cells than the header; its cells are what could be read. Files whose header differs are an error. lines: may
    cells hold line ends? Files are then not split.
    """
    read = spark.read.option("header", True).option("encoding", "UTF-8").option("sep", sep).option("multiLine", lines).option("escape", '"')
    names = read.csv(path).columns
    schema = types.StructType([types.StructField(x, types.StringType()) for x in (*names, "corrupt")])
    rows = read.schema(schema).option("enforceSchema", False).option("columnNameOfCorruptRecord", "corrupt").csv(path)
    return rows.withColumn("pos", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))


def read_register_csv(spark: SparkSession, path: str, name: str, lines: bool = False, **columns: str | None) -> DataFrame:
    """A register published as CSV with a header: register_rows() of all its lines. Of a corrupt line what could be read counts."""
    return register_rows(read_csv(spark, path, lines=lines), name, **columns)


_ROW = re.compile(r"<tr\b.*?(?=<tr\b|</table|$)", re.I | re.S)
_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</tr|$)", re.I | re.S)
_TAG = re.compile(r"<[^>]+>")


def table_rows(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """key, pos and cells of every table row of a page, tags off and character references decoded."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, page in zip(pdf[key], pdf[body], strict=True):
                for pos, row in enumerate(_ROW.findall(page or "")):
                    cells = [" ".join(html.unescape(_TAG.sub(" ", c)).split()) for c in _CELL.findall(row)]
                    if cells:
                        out.append((k, pos, cells))
            yield pd.DataFrame(out, columns=[key, "pos", "cells"])

    return pages.select(key, body).mapInPandas(rows, f"{key} {pages.schema[key].dataType.simpleString()}, pos int, cells array<string>")


def read_register_html(pages: DataFrame, name_index: int, min_cells: int, header: tuple[str, ...] = (), key: str = "page_id", body: str = "html") -> DataFrame:
    """Names out of HTML tables: rows with enough cells, header words and repeated names out."""
    own = table_rows(pages, key, body).where(F.size("cells") >= min_cells).withColumn("name", F.get("cells", F.lit(name_index)))
    own = own.where((F.col("name") != "") & ~F.lower("name").isin(*[h.lower() for h in header]))
    first = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(key, "pos"))
    return own.withColumn("_n", first).where("_n = 1").drop("_n")


def count_cell(cell: T.Col) -> Column:
    """A printed count without its thousands commas; null where it is suppressed or no number."""
    text = F.lower(F.trim(T.c(cell)))
    return F.when(~text.isin(*SUPPRESSED), F.replace(text, F.lit(","), F.lit("")).try_cast("double").cast("long"))


def read_counts(spark: SparkSession, path: str, name: str, count: str) -> DataFrame:
    """name and n of a file of counts; its delimiter is whichever of tab and comma its head has more of."""
    # The head is a few lines, and is for the delimiter alone.
    sample = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:4000]
    rows = read_csv(spark, path, "\t" if sample.count("\t") > sample.count(",") else ",")
    for x in (name, count):
        if x not in rows.columns:
            raise ValueError(f"no column named {x!r} in the counts; columns are {rows.columns}")
    return rows.select(F.trim(name).alias("name"), count_cell(count).alias("n")).where("n is not null and name <> ''")
