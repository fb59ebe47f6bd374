"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, shared_folder

#: Words everywhere in this package: runs of anything but space, tab, line feed, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Run ``fn`` on every Arrow batch; it returns the output columns by name.

    Nothing is kept between batches, so a task holds one batch (spark.sql.execution.arrow.
    maxRecordsPerBatch rows or maxBytesPerBatch bytes) at a time.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type)
                     for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand tasks Arrow batches of at most ``rows`` rows, so whole texts take a tenth of the usual memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one job under the shared folder, removed when the driver ends."""
    at = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(at)
    fs.create_dir(path, recursive=True)
    atexit.register(_remove, at)
    return at


def _remove(at: str) -> None:
    fs, path = pafs.FileSystem.from_uri(at)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def keep_rows(df: DataFrame, wanted: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of ``df`` that ``wanted`` marks, all columns as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array(wanted(batch), pa.bool_()))
        return {name: kept.column(k) for k, name in enumerate(kept.schema.names)}

    return per_batch(df, run, schema)


def text_key() -> Column:
    """The 64-bit hash that stands for a text; NULL is the empty text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A table of keys with at most this many rows (some 50 MB) is sent to every task.
MAX_KEYS = 500_000


def beside(keys: DataFrame) -> DataFrame:
    """``keys`` for a join with a table of whole texts: sent to the texts if counted as few, else met in a shuffle."""
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else keys


def one_per_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of ``classes`` (text_key, component).

    The row with the smallest doc_id stays (rows without one come last), among these the first by
    two hashes of the whole row; of equal rows one stays. Minima are combined before the shuffle
    and hold no text. Columns of ``docs`` stay as they are, whatever their names.
    """
    columns, names = [F.col(f"`{c}`") for c in docs.columns], [unused(docs, "_r1"), unused(docs, "_r2")]
    cells = [x for c in columns for x in (c.cast("string"), c.isNull())]
    keyed = docs.withColumns({names[0]: F.xxhash64(*cells), names[1]: F.xxhash64(F.lit(1), *cells)})
    rows = keyed.select(F.col("doc_id").alias("id"), text_key().alias("text_key"), F.col(names[0]).alias("r1"), F.col(names[1]).alias("r2"))
    first = rows.join(classes.select("text_key", "component"), "text_key").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("f"))
    heads = cut_lineage(first.select(F.col("f.r1").alias(names[0]), F.col("f.r2").alias(names[1])))
    kept = keyed.join(beside(heads), names, "left_semi")
    again = kept.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*names)
    again = cut_lineage(again)  # rows that are repeated as a whole
    if again.isEmpty():
        return kept.select(*columns)
    again = beside(again)
    once = kept.join(again, names, "left_semi").dropDuplicates(names)
    return kept.join(again, names, "left_anti").unionByName(once).select(*columns)
