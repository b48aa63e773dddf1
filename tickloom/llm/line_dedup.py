"""Line deduplication on built-in functions only.

Lines are hashed to 128 bits and dealt to partitions that are ranges of the hash times slices of the documents: the bounds
are known beforehand, as hashes are uniform, and a very common line spreads over all slices. Partitions are sorted by
(hash, document, position), and a window streams over them to mark the first occurrence of a line in each document. Counts
are added up within the partitions before they are shuffled. The result holds no text: each document that loses lines gets
a sparse bitmap of them (all other bits: keep), and documents without one are left where they are if the bitmaps are few.

Defined cases: a document is a distinct (id, text) pair, so repeated rows are one document and get equal bitmaps; a null
id is an id of its own; null and empty texts have one empty line; lines whose key is shorter than ``min_chars`` code
points always stay; an empty table gives an empty result; extra columns are carried through unchanged, whatever their
names, but for those of the names asked for as counts, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, if_small, materialise, named, spread

#: What is stripped at both ends of a line: the space and U+0009 to U+000D.
STRIPPED = " \t\n\x0b\x0c\r"
#: Slices of the documents over which the occurrences of a line are dealt.
SLICES = 16


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _identity(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_ld_id"), F.xxhash64(_text(text_col)).alias("_ld_text")]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """One row for each document that loses lines: ``_ld_id, _ld_text`` (its identity) and ``_ld_drop``.

    ``_ld_drop`` lists word numbers with 64 bits each: line i is dropped if bit i % 64 of word i // 64 is set; absent words
    keep all lines. ``keep='none'`` drops every line found in at least ``min_docs`` documents; ``keep='first'`` spares its
    first occurrence, by document and then position.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    key = F.btrim(F.col("line"), F.lit(STRIPPED))
    lines = (
        docs.select(*_identity(id_col, text_col), F.posexplode(F.split(ascii_lower(_text(text_col)), "\n", -1)).alias("pos", "line"))
        .select("_ld_id", "_ld_text", "pos", key.alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "_ld_id", "_ld_text", "pos")
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = min(SLICES, partitions)
    ranges = partitions // slices
    place = F.shiftright(F.shiftrightunsigned("h1", 33) * ranges, 31) * slices + F.pmod(F.xxhash64("_ld_id", "_ld_text"), F.lit(slices))
    dealt = lines.withColumn("place", place.cast("int")).repartitionById(ranges * slices, "place")
    in_document = Window.partitionBy("place", "h1", "h2", "_ld_id", "_ld_text").orderBy("pos")
    placed = dealt.withColumn("first", F.row_number().over(in_document) == 1).drop("place")
    placed = materialise(placed, "line-places")
    origin = [F.min(F.struct("_ld_id", "_ld_text", "pos")).alias("origin")] if keep == "first" else []
    common = placed.filter("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *origin).filter(F.col("n") >= min_docs).drop("n")
    common = if_small(materialise(spread(common), "common-lines"), 56)
    hit = placed.join(common, ["h1", "h2"])
    if keep == "first":
        hit = hit.filter(~F.struct("_ld_id", "_ld_text", "pos").eqNullSafe(F.col("origin")))
    words = hit.groupBy("_ld_id", "_ld_text", (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmaps = words.groupBy("_ld_id", "_ld_text").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("_ld_drop"))
    return materialise(bitmaps, "bitmaps")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """The documents with their bitmaps applied: ``text_col`` holds the lines kept, ``lines_col`` and ``dropped_col`` count."""
    every, drop, kept = free_names(docs, "_all", "_drop", "_kept")
    marks = if_small(bitmaps, F.lit(32) + F.size("_ld_drop") * 16)
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("b._ld_id")) & (F.xxhash64(_text(f"d.{text_col}")) == F.col("b._ld_text"))
    joined = docs.alias("d").join(marks.alias("b"), same, "left").select("d.*", F.col("b._ld_drop").alias(drop)).withColumn(every, F.split(_text(text_col), "\n", -1))
    # The words between two that are given hold zeros.
    gap = lambda x, i: x["word"] - F.when(i > 0, F.get(drop, i - 1)["word"]).otherwise(-1) - 1
    dense = F.flatten(F.transform(drop, lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(x, i)), F.array(x["bits"]))))
    joined = joined.withColumn(drop, dense)
    stays = F.expr(f"filter(`{every}`, (line, i) -> (shiftright(coalesce(get(`{drop}`, int(i / 64)), 0L), i % 64) & 1) = 0)")
    joined = joined.withColumn(kept, F.when(F.col(drop).isNotNull(), stays))
    counts = {lines_col: F.size(every).cast("long"), dropped_col: (F.size(every) - F.coalesce(F.size(kept), F.size(every))).cast("long")}
    text = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(_text(text_col))
    rest = [text.alias(c) if c == text_col else x for c, x in zip(docs.columns, named(docs), strict=True) if c not in counts]
    return joined.select(*rest, *[x.alias(c) for c, x in counts.items()])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``keep_bitmaps`` and ``drop_lines`` in one: the columns of ``docs``, with the lines left."""
    names = {k: options[k] for k in ("id_col", "text_col") if k in options}
    counts = free_names(docs, "_lines", "_dropped")
    return drop_lines(docs, keep_bitmaps(docs, **options), **names, lines_col=counts[0], dropped_col=counts[1]).select(*named(docs))
