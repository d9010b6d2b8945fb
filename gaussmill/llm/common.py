"""Shared plumbing of the training-data operators.

Conventions that every operator of this subpackage follows:

* A null text is an empty text.  A null id is an ordinary id value.
* Extra columns never collide with working columns: whole input rows travel in
  one struct column and are unpacked again only by filtering operators.
* Intermediate results that must not change between two uses (row numbers, block
  names, bucket contents) are written as Parquet below ``spark.checkpoint.dir``,
  which all executors share, so a lost executor costs a re-read and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaussmill.runtime import Scratch, ship_package

ROW, RID = "row", "rid"
_scopes: list[Scratch] = []
_held: dict = {}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


@contextmanager
def scratch(tables: Scratch) -> Iterator[Scratch]:
    """Tables that operators write meanwhile belong to `tables`, and go when it says so; all others stay."""
    _scopes.append(tables)
    try:
        yield tables
    finally:
        _scopes.pop()


def new_path(spark: SparkSession, name: str) -> str:
    return (_scopes[-1] if _scopes else Scratch(spark)).new_path(name)


def worker_cached(key, make: Callable):
    """An object that a Python worker keeps from task to task.  It keeps one: another key's object replaces it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: Rows for each task and file of a table whose number of rows is known to have a bound.
ROWS_A_FILE = 50_000


def written(df: DataFrame, name: str, path: str | None = None, *, most: int | None = None, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Write df once in the shared folder and read it from there: a lineage cut that outlives executors.

    `most`, a bound of its rows, keeps a small table from being written as
    hundreds of tiny files where adaptive coalescing is off.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df = df if most is None else df.coalesce(-(-most // rows_a_file) or 1)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """One struct column `row` with every input column, and working columns beside it."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias(ROW), *extra)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def text_of(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of a text column: bounds what a Python worker builds at once."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Components of a graph given as rows (a long, b long), `most` at most if given: rows (node, root), root the smallest node of its component.

    Alternates large-star and small-star steps on written tables until every
    edge points from a node to its root.  Only a row count and a checksum reach
    the driver.  Nodes without an edge to another node are absent; an empty
    input gives an empty result.
    """
    same = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.where("a <> b").select(same[1].alias("u"), same[0].alias("v")).distinct(), "edges", most=most)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if seen == tuple(state) or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, most = tuple(state), 2 * state["n"]
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star", most=most)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star", most=most)
