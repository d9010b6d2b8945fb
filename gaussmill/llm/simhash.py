"""SimHash near-duplicate detection on a Gray-order hierarchical index.

A fingerprint's bit is 1 when it is set in more than half of the XXH64 hashes of
the document's word shingles.  Distinct fingerprints are filed under masked bit
patterns: two fingerprints that differ in at most `radius` bits agree on at
least `4 - radius` of four 16-bit fields, so they meet under at least one upper
node (a mask that keeps `4 - radius` fields, and the kept bits).  Under a node
they are sorted by Gray rank and factored into a tree: a tree node holds the
bits that all fingerprints below it share and its parent doesn't already hold.
A search adds up the differences on the way down and drops a whole group as
soon as the sum exceeds the radius.

A node with too many fingerprints is split by masks over the bits that its own
mask leaves free, which bounds every group by 2^(free bits) distinct values.
Groups give spanning links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import ROW, RID, col, connected_components, is_empty, map_batches, quoted, text_of, unpacked, written

WORDS, RADIUS, SEED = 3, 2, 42
CHUNK, FANOUT, SPLIT = 1 << 15, 16, 4096
U64 = np.uint64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a whole text; 0 without words.  Only A-Z are lower-cased; words end at ASCII white space."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    total = max(1, len(tokens) - words + 1)
    ones, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for start in range(0, total, CHUNK):
        part = tokens[start : start + CHUNK + words - 1]
        if len(part) <= words:
            hashes = [digest(join(part), SEED)]
        else:
            hashes = [digest(x, SEED) for x in map(join, zip(*(part[i:] for i in range(words)), strict=False))]
        bits = np.unpackbits(np.array(hashes, U64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = fp.astype(U64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> U64(shift))
    return rank


class GrayIndex:
    """Static tree over distinct fingerprints in Gray order."""

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.fanout = fanout
        ones, zeros = self.values, ~self.values
        levels = [(~U64(0) * np.ones(len(self.values), U64), self.values)]
        while len(ones) > 1:
            cut = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            levels.append((ones | zeros, ones))
        self.levels = levels[::-1]
        self.residual = [self.levels[0][0]] + [low[0] & ~np.repeat(high[0], fanout)[: len(low[0])] for high, low in zip(self.levels, self.levels[1:], strict=False)]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, value) of all pairs within the radius."""
        q, node, acc = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (_, pattern) in enumerate(self.levels):
            if depth:
                width = len(pattern)
                child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                q, acc = np.repeat(q, self.fanout), np.repeat(acc, self.fanout)
                there = child < width
                q, acc, node = q[there], acc[there], child[there]
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & self.residual[depth][node])
            near = acc <= radius
            q, node, acc = q[near], node[near], acc[near]
        return q, node


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_links(values: np.ndarray, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, root) that span the components of distinct values under Hamming distance <= radius."""
    if len(values) == 2:
        near = int(values[0] ^ values[1]).bit_count() <= radius
        return (values[1:], values[:1]) if near else (values[:0], values[:0])
    index = GrayIndex(values)
    parent = np.arange(len(values))
    for start in range(0, len(values), step):
        q, v = index.search(index.values[start : start + step], radius)
        q = q + start
        for a, b in zip(q[q < v].tolist(), v[q < v].tolist(), strict=True):
            ra, rb = _find(parent, a), _find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    root = np.array([_find(parent, i) for i in range(len(values))])
    moved = root != np.arange(len(values))
    return index.values[moved], index.values[root[moved]]


def _masks(bits: list[int], radius: int) -> list[int]:
    """Masks over four fields of these bit positions: any two values within the radius agree under one of them."""
    size = len(bits) // 4
    fields = [sum(1 << b for b in bits[i * size : (i + 1) * size]) for i in range(4)]
    return [sum(kept) for kept in combinations(fields, 4 - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (mask, key, fp): each fingerprint under each upper node."""
    cells = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    return nodes.select("fp", F.explode(F.array(*cells)).alias("n")).select("n.mask", "n.key", "fp")


def _links_of_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (mask, key): links of each run.  Holds one run at a time."""
    rest = [np.zeros(0, np.int64)] * 3

    def links(parts: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            if end - start > 1:
                x, y = spanning_links(parts[2][start:end].view(U64), radius)
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        parts = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
        ends = np.flatnonzero((np.diff(parts[0]) != 0) | (np.diff(parts[1]) != 0)) + 1
        if len(ends):
            yield links(parts, ends)
            rest = [p[ends[-1] :] for p in parts]
        else:
            rest = parts
    if len(rest[0]):
        yield links(rest, np.array([len(rest[0])]))


def near_links(nodes: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Rows (a, b) of fingerprints that span, with repeats, all links within the radius among distinct values `fp`."""
    if not 0 < radius < 4:
        raise ValueError("the radius is 1 to 3")
    masks = _masks(list(range(64)), radius)
    filed = _filed(nodes, masks)
    hot = written(filed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > split).select("mask", "key"), "hot-nodes")
    if not is_empty(hot):
        finer = []
        for m in masks:
            free = [b for b in range(64) if not m >> b & 1]
            own = hot.where(F.col("mask") == F.lit(_signed(m)))
            part = filed.where(F.col("mask") == F.lit(_signed(m))).join(own, ["mask", "key"], "left_semi")
            finer.append(_filed(part.select("fp"), [m | x for x in _masks(free, radius)]))
        filed = filed.join(hot, ["mask", "key"], "left_anti")
        for part in finer:
            filed = filed.unionByName(part)
    dealt = filed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return map_batches(dealt, lambda batches: _links_of_groups(batches, radius), "a long, b long")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (fp, root, component_id) from rows (id, fp): one root per component, and the smallest non-null id in it."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    roots = connected_components(written(near_links(nodes.select("fp"), radius), "near-links"))
    held = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = held.groupBy("root").agg(F.min("low").alias("component_id"))
    return held.join(lows, "root").select("fp", "root", "component_id")


def near_duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other.
    A null id never becomes a component_id unless all ids of a component are
    null.  Repeated rows are repeated in the result.
    """
    rows = docs.select(col(doc_id).alias("id"), text_of(text).alias("text"))
    prints = written(map_batches(rows, lambda b: _fingerprints(b, words), f"id {dict(rows.dtypes)['id']}, fp long"), "simhash")
    found = prints.join(components(prints, radius), "fp")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the input's columns: the smallest id, nulls last, the first read of rows with one id."""
    numbered = written(docs.select(F.struct(*[col(c) for c in docs.columns]).alias(ROW), F.monotonically_increasing_id().alias(RID)), "documents")
    light = numbered.select(RID, F.coalesce(F.col(f"{ROW}.{quoted(text)}").cast("string"), F.lit("")).alias("text"))
    prints = written(map_batches(light, lambda b: _fingerprints(b, words), "id long, fp long"), "simhash")
    ids = numbered.select(F.col(RID).alias("id"), F.col(f"{ROW}.{quoted(doc_id)}").alias("own"))
    order = F.struct(F.col("own").isNull().alias("none"), F.col("own"), F.col("id"))
    nodes = components(prints, radius)
    members = written(prints.join(ids, "id").join(nodes.select("fp", "root"), "fp").select("root", "id", "own"), "members")
    best = written(members.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", F.col("best.id").alias("stays")), "groups")
    gone = members.join(best, "root").where("id <> stays").select(F.col("id").alias(RID))
    return unpacked(numbered.join(written(gone, "dropped"), RID, "left_anti"))  # the smaller side: whole rows move only if it is large
