"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes.  Distinct
blocks are sorted and named by integers; then adjacent names are paired, the
distinct pairs are sorted and named, and so on until each document has one
name.  Two documents have the same (block count, name) exactly when their
normalised texts are equal: names stand for contents, never for hashes alone.

A block is sorted by (64-bit hash, content).  Because the content decides only
between blocks with equal hashes, contents are shuffled once, after map-side
combining, to find such blocks; afterwards only integers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import ROW, col, is_empty, text_of, unpacked, written

BLOCK_BYTES = 8192


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _blocks(size: int) -> Column:
    return F.expr(f"transform(sequence(0, greatest(1, cast(ceil(octet_length(norm) / {size}) as int)) - 1), i -> substring(cast(norm as binary), i * {size} + 1, {size}))")


def _hash(block: str, bits: int) -> str:
    return f"xxhash64({block})" if bits == 64 else f"xxhash64({block}) & {(1 << bits) - 1}L"


def _block_names(docs: DataFrame, size: int, bits: int) -> tuple[DataFrame, bool]:
    """Rows (h, content, name): content only where several distinct blocks share h; and whether there are such."""
    distinct = docs.select(F.explode(_blocks(size)).alias("content")).select(F.expr(_hash("content", bits)).alias("h"), "content").distinct()
    count = written(distinct.groupBy("h").agg(F.count("*").alias("c")), "block-hashes")
    named = count.where("c = 1").select("h", F.lit(None).cast("binary").alias("content"))
    shared = not is_empty(count.where("c > 1"))
    if shared:
        named = named.unionByName(distinct.join(count.where("c > 1").select("h"), "h").select("h", "content"))
    return written(named.orderBy("h", "content").select("h", "content", F.monotonically_increasing_id().alias("name")), "block-names"), shared


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, row) of the input and rows (rid, id, sha, blocks, name): a row number, the input columns; the document's
    id, SHA-256 of the normalised text, block count, name.

    `carry` lists the input columns that `row` holds, all when it is None.
    `hash_bits` below 64 exists to test blocks that share a hash.
    """
    held = docs.columns if carry is None else carry
    norm = docs.select(F.struct(F.lit(0).alias("_"), *[col(c) for c in held]).alias(ROW) if not held else F.struct(*[col(c) for c in held]).alias(ROW), col(doc_id).alias("id"), normalised(text_of(text)).alias("norm"))
    names, shared = _block_names(norm.select("norm"), block_bytes, hash_bits)
    base = norm.select(
        ROW,
        "id",
        F.monotonically_increasing_id().alias("rid"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        _blocks(block_bytes).alias("content"),
    ).withColumn("h", F.expr(f"transform(content, x -> {_hash('x', hash_bits)})"))
    base = written(base if shared else base.drop("content"), "documents")
    if shared:
        cells = base.select("rid", F.size("h").alias("n"), F.posexplode(F.arrays_zip("h", "content")).alias("at", "cell")).select("rid", "n", "at", "cell.h", "cell.content")
        cells = cells.join(names.withColumnRenamed("content", "held"), "h").where("held is null or held = content")
    else:
        cells = base.select("rid", F.size("h").alias("n"), F.posexplode("h").alias("at", "h")).join(names.select("h", "name"), "h")
    done = [cells.where("n = 1").select("rid", "name")]
    chains, level = _chains(cells.where("n > 1"), "names-0"), 0
    while not is_empty(chains):
        level += 1
        pairs = chains.select("rid", F.posexplode(F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] as l, coalesce(get(names, 2 * i + 1), -1L) as r))")).alias("at", "p")).select("rid", "at", "p.l", "p.r")
        given = written(pairs.select("l", "r").distinct().orderBy("l", "r").select("l", "r", F.monotonically_increasing_id().alias("name")), f"pair-names-{level}")
        chains = _chains(pairs.join(given, ["l", "r"]), f"names-{level}")
        done.append(chains.where("size(names) = 1").select("rid", F.col("names")[0].alias("name")))
        chains = chains.where("size(names) > 1")
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    light = base.select("rid", "id", "sha", F.size("h").alias("blocks")).join(named, "rid")
    return base.select("rid", ROW), written(light, "identities")


def _chains(cells: DataFrame, name: str) -> DataFrame:
    """Rows (rid, names): a document's names in order.  A chain has one entry for block_bytes of its own document."""
    lists = cells.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("c"))
    return written(lists.select("rid", F.expr("transform(c, x -> x.name)").alias("names")), name)


def _groups(light: DataFrame) -> DataFrame:
    """Rows (blocks, name, best, group_size): of each identity the row that stays, as (none, id, rid).  Written, so that a
    large group's join can be split."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    return written(light.groupBy("blocks", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with the columns of the input.

    Of rows with equal normalised texts the one with the smallest id stays; a
    null id comes after all others, and of rows with one id the first read
    stays.  A null text equals an empty one.  An empty table gives no rows.
    """
    rows, light = identities(docs, doc_id, text, **options)
    found = light.select("rid", "blocks", "name").join(_groups(light), ["blocks", "name"])
    gone = written(found.where("best.rid <> rid").select("rid"), "dropped")  # the smaller side: whole rows move only if it is large
    return unpacked(rows.join(gone, "rid", "left_anti"))


def duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document, also of those that go: doc_id, keep_id, group_size, kept, text_sha256 (see exact_dedup)."""
    _, light = identities(docs, doc_id, text, carry=[], **options)
    found = light.join(_groups(light), ["blocks", "name"])
    return found.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256"))
