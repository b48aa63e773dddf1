"""Inventory of a corpus of strategy scripts: names, duplicates, priorities and indicator calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of scripts that are hard or middling to handle (fixed values).
COMPLEX = ["request.security", "array.", "for ", "while ", "matrix", "varip", "mtf"]
MEDIUM = ["ta.macd", "ta.rsi", "ta.atr", "strategy.exit", "switch"]

#: Words in a script and what they tell about it (fixed values).
TAGS = {
    "crossover": "Uses crossover entries", "crossunder": "Uses crossunder entries/exits", "strategy.exit": "Contains explicit stop/target exits",
    "ta.ema": "EMA-based indicators", "ta.rsi": "RSI filter", "ta.atr": "ATR filter/stops",
}

NAME = r"""strategy\s*\(\s*['"]([^'"]+)['"]"""
CALL = r"ta\.(\w+)\s*\(([^)]+)\)"


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of every file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def script_priority(df: DataFrame, text: str = "text") -> DataFrame:
    """``priority`` 3, 2 or 1 and ``description``."""
    low = F.lower(F.col(text))
    tags = F.concat_ws("; ", *[F.when(low.contains(w), F.lit(t)) for w, t in TAGS.items()])
    return df.withColumns({"priority": F.when(_any(low, COMPLEX), 3).when(_any(low, MEDIUM), 2).otherwise(1), "description": F.coalesce(F.nullif(tags, F.lit("")), F.lit("Custom logic"))})


def script_inventory(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each name and text: the script of the smallest path, with ``name``, ``digest``, priority and description.

    The name is the declared one, else the file's. Texts are compared by their hash.
    """
    stem = F.regexp_extract(F.col(path).cast("string"), r"([^/]+?)(\.[^./]*)?$", 1)
    declared = F.regexp_extract(F.col(text), NAME, 1)
    named = script_priority(df, text).withColumns({"name": F.coalesce(F.nullif(declared, F.lit("")), stem), "digest": F.sha1(F.col(text))})
    same = F.regexp_replace(F.trim(F.lower("name")), r"\s+", " ")
    slim = named.select(same.alias("_same"), "digest", F.struct(F.col(path).alias("path"), "name", "priority", "description").alias("_s"))  # no text is shuffled
    first = slim.groupBy("_same", "digest").agg(F.min_by("_s", "_s.path").alias("_s"))
    return first.select("_s.path", "_s.name", "digest", "_s.priority", "_s.description")


def indicator_census(df: DataFrame, text: str = "text", key: tuple[str, ...] = ()) -> DataFrame:
    """How often each indicator function is called, and with how many different arguments."""
    calls = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(CALL), 1).alias("function"), F.regexp_extract_all(F.col(text), F.lit(CALL), 2).alias("arguments"))
    found = df.select(*key, F.explode(calls).alias("c")).select(*key, "c.function", "c.arguments")
    return found.groupBy(*key, "function").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("arguments").alias("n_arguments"))
