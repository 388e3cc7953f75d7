"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ``[\x20\x09-\x0D]``: the white space that separates words and is stripped from line keys.
WHITE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Stands for a null id inside joins; smaller than every other id.
NULL_ID = -(1 << 63)
#: The column that carries a whole input row, so that no name of its columns can clash with an operator's own.
ROW = "_tw_row"
#: Folders of intermediate tables in the order of their making, for ``scratch``.
_made: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives a lost executor, runs the plan once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables of ``written`` that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._tw_path)
        _made.remove(df._tw_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end all intermediate tables made inside it, but for those of ``written`` put into the list it gives.

    The operators return lazy results that still read their intermediate tables, so the results are to be written inside.
    """
    before, keep = len(_made), []
    try:
        yield keep
    finally:
        stay = {df._tw_path for df in keep}
        for path in _made[before:]:
            if path not in stay:
                _delete(spark, path)
        _made[before:] = [p for p in _made[before:] if p in stay]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def id_key(col: str | Column) -> Column:
    """The id column as a long that equi-joins also match where it is null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NULL_ID))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_row(docs: DataFrame, without: tuple[str, ...] = (), **own: Column) -> DataFrame:
    """The operator's own columns, and in ROW the input's columns except ``without``."""
    row = [F.col(quoted(c)) for c in docs.columns if c not in without] or [F.lit(None).cast("boolean").alias("none")]
    return docs.select(F.struct(*row).alias(ROW), *[c.alias(n) for n, c in own.items()])


def from_row(rows: DataFrame, columns: list[str], **own: Column | str) -> DataFrame:
    """ROW's fields in the order of ``columns``, then the operator's results. A result takes the place of an input column of its name (in any case)."""
    made = {n.lower(): (F.col(c) if isinstance(c, str) else c).alias(n) for n, c in own.items()}
    out = [made.pop(c.lower()) if c.lower() in made else F.col(f"{ROW}.{quoted(c)}").alias(c) for c in columns]
    return rows.select(*out, *made.values())
