"""Sharding by extendible hashing.

A directory maps hash prefixes to shards.  The root holds everything; a bucket
over the byte limit that holds more than one row is split on the next bit, and
only such buckets are.  So a row's shard is its shortest prefix whose bucket
fits.  Prefixes come from 60 bits of the MD5 of the key and, for rows whose keys
agree in all of them, from 60 more bits of the MD5 of the row's number: rows of
one hot key spread like any others.

The directory grows by `step` bits a round.  A round counts bytes under the
prefixes of buckets that are still too large, so its table has at most 2^step
rows for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaussmill.llm.common import ROW, RID, col, is_empty, quoted, text_of, written

LIMIT, STEP, HALF = 1 << 20, 10, 60


def _bits(value: Column) -> Column:
    """The first 60 bits of an MD5, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 2), HALF, "0")


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, carry: list[str] | None = None, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """Rows (row, shard, depth, shard_bytes, shard_docs), one for each input row; `shard` is the prefix.

    A row's size is that of its text in UTF-8; null texts have none.  Null ids
    share one key.  A single row over the limit is a shard of its own.  An
    empty table gives no rows.
    """
    held = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[col(c) for c in held]).alias(ROW), F.monotonically_increasing_id().alias(RID), _bits(col(doc_id)).alias("bits"), F.octet_length(text_of(text)).cast("long").alias("bytes"))
    rows = written(rows, "documents").withColumn("bits", F.concat("bits", _bits(F.col(RID))))
    whole = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if whole["b"] <= limit or whole["n"] <= 1:
        return rows.select(ROW, F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(whole["b"]).cast("long").alias("shard_bytes"), F.lit(whole["n"]).cast("long").alias("shard_docs"))
    done, left, depth = [], rows, 0
    while True:
        to = min(depth + step, 2 * HALF)
        left = left.withColumn("prefix", F.substring("bits", 1, to))
        counts = left.groupBy("prefix").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        levels = counts.select("prefix", "b", "n", F.explode(F.sequence(F.lit(depth + 1), F.lit(to))).alias("depth"))
        under = W.partitionBy("shard")
        levels = levels.withColumn("shard", F.expr("substr(prefix, 1, depth)")).select("prefix", "depth", "shard", F.sum("b").over(under).alias("shard_bytes"), F.sum("n").over(under).alias("shard_docs"))
        fits = levels.where(f"shard_bytes <= {limit} or shard_docs = 1 or depth = {2 * HALF}")
        leaf = written(fits.groupBy("prefix").agg(F.min_by(F.struct("shard", "depth", "shard_bytes", "shard_docs"), "depth").alias("leaf")), "directory")
        found = written(left.join(leaf, "prefix", "left"), "assigned")
        done.append(found.where("leaf is not null").select(ROW, "leaf.*"))
        left = found.where("leaf is null").select(ROW, RID, "bits", "bytes")
        depth = to
        if is_empty(left):
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shard_assignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, shard, depth, shard_bytes, shard_docs."""
    return assign(docs, doc_id, text, carry=[doc_id], **options).select(F.col(f"{ROW}.{quoted(doc_id)}").alias("doc_id"), "shard", "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **options) -> None:
    """Write the rows as Parquet with one folder for each shard."""
    found = assign(docs, doc_id, text, **options).select(f"{ROW}.*", F.concat(F.lit("p"), "shard").alias("shard_prefix"))
    found.repartition("shard_prefix").write.partitionBy("shard_prefix").parquet(path)
