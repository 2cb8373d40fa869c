"""What the operators of this package share: tables, worker code, saved steps."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.session import shared_folder

#: A batch sent to a Python worker holds at most so many rows and bytes, so
#: that long texts do not add up.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the batches sent to Python and let local workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def give_back() -> None:
    """Return to the system what a task has freed: its worker lives on and serves later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def append(
    df: DataFrame,
    make: Callable[[], Callable[..., list]],
    inputs: list[str],
    fields: str,
) -> DataFrame:
    """``df`` with columns that Python adds, a batch of rows at a time.

    ``make`` runs once per task and returns a function from the input columns,
    as Arrow arrays, to one list or array per field of ``fields``. A column of ``df``
    with the name of an added one, in any case, gives way to it.
    """
    prepare(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    new_names = {f.name.lower() for f in added.fields}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new_names]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], *added.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.fieldNames()
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            new = work(*[batch.column(i) for i in at])
            new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(new, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new], names=names)
            batch = new = None
        work = None
        give_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which ends its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`saved` wrote for these; nothing lazy may still read them."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as the text ``''``."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % by


def labelled(
    docs: DataFrame, labels: DataFrame, rows: int, allowed: Column | None = None
) -> DataFrame:
    """``text`` and ``y`` (0 or 1) of at most ``rows`` labelled documents, those with the least hash of their id.

    Only for fitting. Ids labelled twice count with their lower label; labels
    other than 0 and 1, and ids without a document, do not count. Of documents that share
    an id the least text counts, so ``rows`` bounds rows, not ids. The result is
    saved in a few files, whatever its source.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if allowed is not None:
        marked = marked.where(allowed)
    picked = (
        marked.groupBy("doc_id")
        .agg(F.min("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most `rows` pairs of numbers, so they may be sent to every task.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return saved(found.select("text", "y").repartition(8), "labelled")
