"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters between words where words are runs of anything but ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Characters between words where words are ASCII letters, digits and anything beyond ASCII.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which the cluster names in spark.checkpoint.dir.

    Only a session within one machine (as in tests) gets a temporary one where that is unset; a cluster's
    executors would not see it.
    """
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What Spark has shuffled for a job is deleted as the job ends, not whenever the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now, as a checkpoint in the shared folder; for small rows read once or twice."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, plain: bool = False) -> DataFrame:
    """The rows of df, computed now, as a table in the shared folder; for wide rows of which columns are read.

    plain: without dictionaries, which cost time and save nothing where values are mostly hashes.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    with tidy(df.sparkSession):
        df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what written(), given back as df, has written; for when its last reader is done."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Only A-Z change, as the contracts ask; lower() would change other letters too."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def words_by_space(text: Column) -> Column:
    """Words that white space separates; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def words_by_class(text: Column) -> Column:
    """Lower-case words of letters, digits and what lies beyond ASCII; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_RUN), lambda w: w != "")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
