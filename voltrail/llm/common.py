"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltrail.session import SHUFFLE_CLEANUP, scratch_path, setting, shared_dir, stored as store  # noqa: F401

#: ASCII white space, the only separator of words in these operators.
SPACES = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publish(spark: SparkSession, data: bytes, name: str, code: bool = False) -> str:
    """Write a file to the shared folder and have Spark hand it to all executors; its name there."""
    stem, extension = os.path.splitext(name)
    path = f"{scratch_path(spark, stem)}/{stem}-{uuid.uuid4().hex}{extension}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    (spark.sparkContext.addPyFile if code else spark.sparkContext.addFile)(path)
    return path.rsplit("/", 1)[1]


_SHIPPED: set[str] = set()


#: Bytes of a batch between Spark and Python, in place of Spark's own 64 MB: texts are long, and a worker holds a batch several times.
BATCH, SPARKS_BATCH = str(8 << 20), "67108864b"


def ship_code(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once for each application, and bound the batches they exchange where the user has not."""
    application = spark.sparkContext.applicationId
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SPARKS_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if application in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    publish(spark, packed.getvalue(), "voltrail.zip", code=True)
    _SHIPPED.add(application)


def give_back() -> None:
    """Return a worker's free memory to the machine: workers outlive their tasks, and their pools keep what they once used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship_code(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def shuffles_go(spark: SparkSession):
    """A block in which Spark removes what a job shuffled as soon as it ends. It holds for tables made in the block, not for earlier ones."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def cut(df: DataFrame) -> DataFrame:
    """A small table on reliable storage; what it took to shuffle goes at once."""
    shared_dir(df.sparkSession)
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint()


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed package of public tokenizers, or of the folder ``VOLTRAIL_TOKENIZERS`` names."""
    folder = os.environ.get("VOLTRAIL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def text_of(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
