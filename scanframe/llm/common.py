"""Shared by the operators of this folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without the six ASCII white-space characters.
SPACE = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Narrow rows that one task takes at least, where their number is known.
ROWS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later readers don't repeat the work, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than so many narrow rows need; their number grows with the rows.

    The number of shuffle partitions fits the whole input. In rounds over a small table every exchange would start as many
    tasks, each with files of its own, if Spark isn't free to join them.
    """
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def freed(spark: SparkSession) -> None:
    """Spark removes the shuffle files of a plan once the driver has collected it, which a driver with room to spare does
    late; in rounds of joins these files would pile up, so it is asked to do so here."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys in which null equals null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


class Scratch:
    """Tables that an operator writes to the shared folder while it runs: read back, the plan behind them is forgotten.

    Spark carries its estimate of a join's size through a checkpoint; in rounds of joins it would grow to numbers of so
    many digits that planning takes longer than the work. A table that was read from files starts anew.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self._written(df, f"{self.root}/{self.n}")

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables of this scratch folder that nothing reads any more; others are left alone."""
        for folder in {name.rsplit("/", 1)[0] for df in tables for name in df.inputFiles()}:
            if self.root.split("://")[-1] in folder:
                self._delete(folder)
        freed(self.spark)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def result(self, df: DataFrame) -> DataFrame:
        """The operator's result, stored beside the folder, which goes."""
        out = self._written(df, f"{self.root}-result")
        self._delete(self.root)
        return out
