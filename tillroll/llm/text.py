"""Helpers shared by the operators: words, Arrow mapping, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import delete_path, scratch_path

# A word is a maximal run of characters that are not ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SLICE_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    """The words of ``WORD`` as UTF-8; ``bytes.split`` cuts at exactly the six
    ASCII white-space bytes, which occur in no multi-byte character."""
    return text.encode().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows holding about ``limit`` bytes at most; a
    longer text is a run of its own."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, b in enumerate(size.tolist()):
        if i > start and held + b > limit:
            yield start, i - start
            start, held = i, 0
        held += b
    yield start, len(size) - start


def map_texts(df: DataFrame, carry: list[Column], text: Column,
              make: Callable[[], Callable[[list], list[pa.Array]]],
              result: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``carry`` columns plus the columns of ``result`` (a DDL string), row by
    row.  ``make()`` runs once a task and gives the function from a list of
    texts to one Arrow array per result column; it sees ``limit`` bytes of text
    at a time, so memory does not follow the batch size in rows."""
    src = df.select(*carry, text.alias("_text"))
    fields = T.StructType.fromDDL(result).fields
    schema = T.StructType([*src.schema.fields[:-1], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            k = b.num_columns - 1
            for start, length in byte_slices(b.column(k), limit):
                part = b.slice(start, length)
                out = f(part.column(k).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *out], names=names)

    return src.mapInArrow(run, schema)


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution inside go when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _write(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    with _cleaned_shuffles(df.sparkSession):
        df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read again: it is computed
    once, later jobs survive the loss of executors, and its shuffle files go."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


@contextmanager
def borrowed(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``written``, and deleted at the end: for a table that is read in the block
    only, where what comes of it is written too."""
    path = _write(df, name)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_path(df.sparkSession, path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join of tables that both grow with the rows.  The planner counts an exploded
    table as large as the one it comes from, and a written one as its packed files: below the
    threshold it would collect either in the driver to broadcast it."""
    return df.hint("merge")


def computed_once(value: Column) -> Column:
    """``value`` through a generator.  A filter on a column that an expensive
    expression makes is pushed below it with a copy of the expression, and of all
    that it is made of; a generated column keeps the filter above."""
    return F.explode(F.array(value))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())
