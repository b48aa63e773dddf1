"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Turns ASCII upper case into lower case and leaves other bytes alone.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse, which on a
    cluster must not be a folder of one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if found.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back, so that a lost executor costs no rerun."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters unchanged (``lower`` would also change letters such as the Kelvin sign)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of every fit: crc32 of doc_id as text, mod 4, is 2 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def spread(df: DataFrame) -> DataFrame:
    """Let an aggregate stand on its own before a join: Spark splits the partitions of a hot key on the other side of a
    join only if both sides are shuffled for that join."""
    return df.hint("rebalance")


#: Texts in a batch between Spark and Python: Spark's default of 10,000 rows is meant for narrow rows.
BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, with Arrow batches fit for texts: lowers the session's setting if it stands at its default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name, "10000") == "10000":
        df.sparkSession.conf.set(name, str(BATCH))
    return df


#: Bytes of a table that may be sent to every task.
LIGHT = 16 << 20


def if_small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df``, a table that is cheap to read, for one side of a join: broadcast if it is measured small, else shuffled."""
    size = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= LIGHT else df
