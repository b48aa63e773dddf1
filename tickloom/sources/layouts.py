"""Delimited files of one path, each read by its own heading and delimiter.

A first pass over the text finds where each file begins and takes its first 2048 characters, in tasks. Files with the same
heading and delimiter make up a layout; each layout is one read of Spark's own CSV source. What reaches the driver is a row
for each file, as its list of files does anyway.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters at the head of a file from which its delimiter is told.
HEAD = 2048


class Layout(NamedTuple):
    sep: str
    heading: str
    files: list[str]


def _delimiter(head: Column) -> Column:
    """Tab or semicolon if the head has more of it than of commas, else the comma."""
    count = lambda sign: F.length(head) - F.length(F.replace(head, F.lit(sign), F.lit("")))
    return F.when(count("\t") > count(","), "\t").when(count(";") > count(","), ";").otherwise(",")


def _plain(uri: str) -> str:
    """A file's path as a reader takes it: decoded, its pattern signs escaped."""
    path = unquote(urlparse(uri).path) if uri.startswith("file:") else unquote(uri)
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def layouts(spark: SparkSession, path: str | list[str], sep: str | None = None) -> list[Layout]:
    """The layouts of the files under ``path``, in the order of their first files; empty files have none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value"))
    lines = lines.filter("start = 0")
    begins = lines.filter(F.length(F.trim("value")) > 0).groupBy("file").agg(F.min("id").alias("first"))
    # A line has a character at least, its end: the head lies in as many lines.
    near = lines.join(begins, "file").filter((F.col("id") >= F.col("first")) & (F.col("id") < F.col("first") + HEAD))
    line = F.struct("id", F.substring("value", 1, HEAD).alias("text"))
    heads = near.groupBy("file").agg(F.min_by("value", "id").alias("heading"), F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.substring(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), 1, HEAD)
    rows = heads.select("file", "heading", (F.lit(sep) if sep else _delimiter(head)).alias("sep")).collect()
    found: dict[tuple[str, str], list[str]] = {}
    for r in sorted(rows):
        found.setdefault((r["sep"], r["heading"].rstrip("\r")), []).append(_plain(r["file"]))
    return [Layout(s, h, files) for (s, h), files in found.items()]


def read_layouts(spark: SparkSession, path: str | list[str], sep: str | None = None) -> list[DataFrame]:
    """One frame of texts for each layout under ``path``; folders named ``column=value`` add their columns."""
    found = layouts(spark, path, sep)
    if not found:
        return [spark.read.csv(path, header=True, sep=sep or ",")]
    frames = []
    for layout in found:
        reader = spark.read.options(header=True, sep=layout.sep)
        if isinstance(path, str) and not re.search(r"[\[\]{}*?]", path) and any("=" in f for f in layout.files) and _plain(path) not in layout.files:
            reader = reader.option("basePath", path)
        frames.append(reader.csv(layout.files))
    return frames
