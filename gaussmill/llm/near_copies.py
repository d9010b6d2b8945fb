"""Near-copies by word-shingle similarity on long SimHash fingerprints.

A 64-bit fingerprint can't tell a similarity of 0.8 from less: such texts differ
in about ten bits, out of reach of masks that must agree exactly.  Here a
fingerprint has 2,048 bits, each the sign of a signed sum over the distinct
shingles of the whole text (a count sketch turned by Walsh-Hadamard steps), and
the angle between two fingerprints gives the similarity of their texts, with a
standard error of 0.02 at 0.8.  Copies are texts with one digest of the sorted
shingle set: fingerprints of few shingles are equal too often.

Upper nodes of the index are parts of the shingle set: shingles fall by hash
into as many cells as make two to four of them meet in one, and the contents of
the first 24 cells are nodes.  Two texts of similarity 0.8 share all of a cell
with a chance of 0.4 or more, so they have no node in common once in 300,000
pairs.  Texts near a size limit are filed for both sizes.  Nodes with one
document vanish before any fingerprint moves; those with more than `split` are
dealt into parts by a hash of the id.

Under a node, fingerprints in Gray order are compared with group leaders.  A
group is skipped as a whole when the differences to its leader exceed twice the
radius, since its members differ from the leader by no more than the radius.

No step gives out pairs.  A node gives spanning links: sure ones, and the
clusters that pairs which estimates can't exclude make.  Then

1. one sure link of each text is compared by shingle sets; those that hold give
   the first components;
2. in clusters with several components, each text's most similar text of another
   component is compared likewise, and components grow;
3. what is still open is settled exactly.  Clusters that share a text form an
   arena; its texts outside the arena's largest component are compared, set
   against set, with all texts of the arena that belong to another component.
   Arenas are dealt in blocks, so that a task holds two blocks and each further
   block costs another copy of the fewer texts.  Parts of a split node are
   brought together here: its texts outside the node's largest component travel
   to every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import ROW, RID, col, connected_components, map_batches, quoted, slices, unpacked, written
from gaussmill.llm.simhash import SEED, U64, gray_rank

WORDS, SIMILARITY = 5, 0.8
BITS, CELLS, LOOSE, SPLIT = 2048, 24, 7, 1024
#: Rows that a task compares: of fingerprints, and of shingle sets.
ROWS_A_TASK, SETS_A_TASK = 20_000, 2_000
#: Estimates from SLACK above the limit on are sure enough to link, until their shingle sets are compared; those more than BELOW under it (four standard errors) are no links.
SLACK, BELOW = 0.06, 0.08


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    h = (h + U64(salt)) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 hashes of the word shingles of a whole text; a text of fewer words is one shingle, one of none has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) <= words:
        return np.array([digest(join(tokens), SEED)] if tokens else [], U64)
    return np.unique(np.fromiter((digest(x, SEED) for x in map(join, zip(*(tokens[i:] for i in range(words)), strict=False))), U64))


def nodes_of(hashes: np.ndarray) -> np.ndarray:
    """Keys of the upper nodes of a shingle set."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.int64)
    out = []
    for size in sorted({n.bit_length(), int(n / SIMILARITY + 1e-9).bit_length()}):
        cells = max(8, 1 << (size - 1 if size < LOOSE else size - 2))  # of the size alone: partners must have the same cells
        cell = _mixed(hashes, 1) & U64(cells - 1)
        used = cell < CELLS
        cell, order = cell[used], np.argsort(cell[used], kind="stable")
        if not len(cell):
            continue
        cell = cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sums = np.add.reduceat(_mixed(hashes[used][order], 2), starts)
        out.append(_mixed(sums + cell[starts] * U64(0x2545F4914F6CDD1D), size))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _turned(v: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row."""
    rows, width = v.shape
    step = 1
    while step < width:
        v = v.reshape(rows, -1, 2, step)
        v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2)
        step *= 2
    return v.reshape(rows, width)


_FLIPS = 1.0 - 2.0 * (_mixed(np.arange(BITS, dtype=U64), 3) & U64(1)).astype(np.float32)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BITS / 64 words for each shingle set."""
    sums = np.zeros((len(sets), BITS), np.float32)
    for row, h in zip(sums, sets, strict=True):
        mixed = _mixed(h, 4)
        row += np.bincount((mixed >> U64(32)).astype(np.int64) % BITS, 1.0 - 2.0 * (mixed & U64(1)).astype(np.float64), BITS).astype(np.float32)
    turned = _turned(_turned(sums) * _FLIPS)
    return np.packbits(turned > 0, axis=1).view(U64)


def similarities(bits: np.ndarray, size: float, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of a text to others, and the numbers of differing bits.  Texts without shingles are alike."""
    differ = np.bitwise_count(others ^ bits).sum(axis=1, dtype=np.int64)
    common = np.cos(np.pi * differ / BITS) * np.sqrt(size * sizes)
    return np.where(size + sizes == 0, 1.0, common / np.maximum(size + sizes - common, 1e-9)), differ


def _reach(similarity: float) -> float:
    """Differing bits of two texts of this similarity, at most."""
    return np.arccos(2 * similarity / (1 + similarity)) / np.pi * BITS


def _columns(found: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [np.zeros(0, k) for k in kinds]


def node_links(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of one node: sure links (a, b) that span what sure ones hold together; and (text, cluster) of the texts that possible pairs
    hold together with others, a cluster named by one of its texts."""
    order = np.lexsort((ids, gray_rank(bits[:, 0])))
    ids, sizes, bits = ids[order], sizes[order].astype(float), bits[order]
    sure, least, reach = similarity + SLACK, similarity - BELOW, 2 * _reach(similarity - BELOW)
    held, might, group, leaders, out = np.arange(len(ids)), np.arange(len(ids)), np.zeros(len(ids), np.int64), [0], []

    def tie(i: int, others: np.ndarray, alike: np.ndarray) -> None:
        for j in others[alike >= sure].tolist():
            if held[i] != held[j]:
                held[held == held[i]] = held[j]
                out.append((int(ids[i]), int(ids[j])))
        for j in others[alike >= least].tolist():
            if might[i] != might[j]:
                might[might == might[i]] = might[j]

    for i in range(1, len(ids)):
        first = np.array(leaders)
        alike, differ = similarities(bits[i], sizes[i], bits[first], sizes[first])
        tie(i, first, alike)
        inside = np.flatnonzero((differ <= reach)[group[:i]] & (held[:i] != held[i]))
        if len(inside):
            tie(i, inside, similarities(bits[i], sizes[i], bits[inside], sizes[inside])[0])
        nearest = int(differ.argmin())
        if 2 * differ[nearest] <= reach:
            group[i] = nearest
        else:
            group[i] = len(leaders)
            leaders.append(i)
    several = np.flatnonzero(np.bincount(might, minlength=len(ids))[might] > 1)
    return out, list(zip(ids[several].tolist(), ids[might[several]].tolist(), strict=True))


def best_partners(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of a cluster outside its largest component, the most similar text of another component, if the pair is possible."""
    common, counts = np.unique(roots, return_counts=True)
    out = []
    for i in np.flatnonzero(roots != common[counts.argmax()]).tolist():
        others = np.flatnonzero(roots != roots[i])
        found = similarities(bits[i], float(sizes[i]), bits[others], sizes[others].astype(float))[0]
        if found.max() >= similarity - BELOW:
            out.append((int(ids[i]), int(ids[others[found.argmax()]])))
    return _columns(out, (np.int64, np.int64))


def open_texts(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray, few: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, arena) of the texts in possible pairs of two components, one of the pair in `few`; an arena is named by one of its texts."""
    label, touched = np.arange(len(ids)), np.zeros(len(ids), bool)
    for i in np.flatnonzero(few).tolist():
        others = np.flatnonzero(roots != roots[i])
        found = others[similarities(bits[i], float(sizes[i]), bits[others], sizes[others].astype(float))[0] >= similarity - BELOW]
        if len(found):
            touched[i] = touched[found] = True
            label[np.isin(label, label[found])] = label[i]
    there = np.flatnonzero(touched)
    return ids[there], ids[label[there]]


def exact_links(ids: np.ndarray, roots: np.ndarray, few: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span what pairs (one of `few`, any text) of the similarity hold together beyond the components; by shingle sets."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate([*sets, np.zeros(0, U64)]), return_inverse=True)[1]
    ends = np.r_[0, np.cumsum(sizes)]
    totals = lambda marks: np.r_[0, np.cumsum(marks[codes])]
    label, out, marks = roots.copy(), [], np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)
    for i in np.flatnonzero(few).tolist():
        own = codes[ends[i] : ends[i + 1]]
        marks[own] = 1
        upto = totals(marks)
        marks[own] = 0
        common = upto[ends[1:]] - upto[ends[:-1]]
        alike = (common >= similarity * (sizes + sizes[i] - common) - 1e-9) & (label != label[i])
        for j in np.flatnonzero(alike).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingle_hashes(t, words) for t in part.column(1).to_pylist()]
                bits = [row.tobytes() for row in fingerprints(sets)]
                nodes = pa.array([nodes_of(s) for s in sets], pa.list_(pa.int64()))
                digests = pa.array([sha256(s.tobytes()).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary()), nodes, digests], names=["id", "n", "bits", "nodes", "print"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, work, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first `keys` columns: the columns that `work` makes of each group's other columns.  Holds one group at a time.

    Binary columns reach `work` as lists, all others as arrays.
    """
    rest: list[pa.RecordBatch] = []

    def columns_of(table: pa.Table) -> list:
        plain = table.combine_chunks()
        return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in plain.columns[keys:]]

    def made(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        held = [work(*columns_of(t)) for t in tables if t.num_rows > 1]
        held = [h for h in held if len(h[0])]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held])) for k in range(len(names))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        key = [table.column(k).to_numpy() for k in range(keys)]
        ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        cuts = np.r_[0, ends]
        for at in range(0, len(ends), 512):
            yield from made([table.slice(s, e - s) for s, e in zip(cuts[at : at + 512], ends[at : at + 512], strict=False)])
        rest = table.slice(int(cuts[-1])).to_batches()
    if rest:
        yield from made([pa.Table.from_batches(rest)])


def _bits(held: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), U64).reshape(-1, BITS // 64)


def _by_group(rows: DataFrame, keys: list[str], work, names: list[str], schema: str, name: str, most: int, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """`work` on the other columns of each group of at most `most` rows, groups dealt by their keys; written."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return written(map_batches(dealt, lambda batches: _groups(batches, len(keys), work, names), schema), name, most=most, rows_a_file=rows_a_task)


def filed_nodes(prints: DataFrame, split: int = SPLIT) -> DataFrame:
    """Rows (node, part, id) of rows (id, nodes): the nodes with several documents, those with more than `split` dealt into parts."""
    cells = prints.select("id", F.explode("nodes").alias("node"))
    counts = written(cells.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "near-nodes")
    part = F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("c") / split)).cast("int")
    return cells.join(counts, "node").select("node", part.alias("part"), "id")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (.., id, ..) with the root of id's component."""
    return rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _mixed_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (.., id, root) of groups that hold several components."""
    several = rows.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*keys)
    return rows.join(several, keys)


def _largest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of rows (.., root) the component with most texts, and how many texts there are in it and beside it."""
    counts = rows.groupBy(*keys, "root").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("total"))


def _checked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set_a, set_b) those whose shingle sets have the similarity."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def _sets(light: DataFrame, ids: DataFrame, words: int, most: int) -> DataFrame:
    """Rows (id, set) of the texts with these ids, `most` at most: the sorted shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                sets = [shingle_hashes(t, words).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return written(map_batches(light.join(ids.distinct(), "id").select("id", "text"), work, "id long, set binary"), "shingle-sets", most=most, rows_a_file=SETS_A_TASK)


def _with(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components after the pairs (a, b), too."""
    most = roots.count() + pairs.count()
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(pairs), most)


def _grown(roots: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """Components after those of at most `most` pairs (a, b) that have the similarity, too."""
    pairs = written(pairs.distinct(), "pairs", most=most)
    count = pairs.count()
    if not count:
        return roots
    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}")), end)
    held = map_batches(pairs.select("a", "b", "set_a", "set_b"), lambda b: _checked(b, similarity), "a long, b long")
    return _with(roots, written(held, "checked", most=count, rows_a_file=SETS_A_TASK))


def _blocks(rows: DataFrame, keys: list[str], part: Column, size: int, *carry: str) -> DataFrame:
    """Rows (keys, part, others, id, root, few, ..) of groups of rows (keys, id, root, ..): each part of a group with each block of its `few`,
    those outside its largest component."""
    sizes = _largest(rows, keys).select(*keys, "main", F.ceil((F.col("total") - F.col("most")) / size).cast("int").alias("blocks"), F.ceil(F.col("total") / size).cast("int").alias("parts"))
    rows = rows.join(sizes, keys).withColumn("part", part).withColumn("few", F.col("root") != F.col("main"))
    every = rows.select(*keys, "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("others"), "id", "root", F.lit(False).alias("few"), *carry)
    few = rows.where("few").withColumn("others", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    few = few.select(*keys, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "others", "id", "root", F.lit(True).alias("few"), *carry)
    return every.unionByName(few)


def _settled(roots: DataFrame, clusters: DataFrame, split_nodes: DataFrame, prints: DataFrame, sets: DataFrame, similarity: float, split: int) -> DataFrame:
    """Components after every possible pair that clusters or split nodes still hold was compared by shingle sets."""
    bits = prints.select("id", "n", "bits")
    open_ = _mixed_groups(_with_roots(clusters, roots), ["node", "part", "cluster"])
    open_ = open_.select(F.xxhash64("node", "part", "cluster").alias("node"), "id", "root")
    parts = _mixed_groups(_with_roots(split_nodes, roots), ["node"]).select("node", "id", "root")
    open_ = written(open_.unionByName(parts), "open-nodes", most=clusters.count() + split_nodes.count())
    dealt = _blocks(open_, ["node"], F.pmod(F.xxhash64("id", "node"), F.col("parts")).cast("int"), split)
    found = _by_group(
        dealt.join(bits, "id").select("node", "part", "others", "id", "n", "bits", "root", "few"), ["node", "part", "others"],
        lambda i, n, b, r, few: open_texts(i, n, _bits(b), r, few, similarity), ["a", "b"], "a long, b long", "open-texts", 2 * open_.count(),
    )
    count = found.count()
    if not count:
        return roots
    arenas = connected_components(found, count)
    arenas = arenas.select(F.col("node").alias("id"), F.col("root").alias("arena")).union(arenas.select("root", "root").distinct())
    members = written(_with_roots(arenas, roots).select("arena", "id", "root"), "arena-texts", most=count)
    dealt = _blocks(members, ["arena"], F.pmod(F.xxhash64("id", "arena"), F.col("parts")).cast("int"), max(1, split // 2))
    dealt = dealt.join(sets, "id").select("arena", "part", "others", "id", "root", "few", "set")
    links = _by_group(
        dealt, ["arena", "part", "others"],
        lambda i, r, few, sets: _columns(exact_links(i, r, few, [np.frombuffer(s, U64) for s in sets], similarity), (np.int64, np.int64)), ["a", "b"], "a long, b long", "exact-links", 4 * members.count(), SETS_A_TASK,
    )
    return _with(roots, links)


def near_components(light: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, split: int = SPLIT) -> DataFrame:
    """Rows (node, root) of rows (id long, text): every id with a link, beside the smallest id of its component."""
    prints = written(map_batches(light, lambda b: _prints(b, words), "id long, n long, bits binary, nodes array<long>, print binary"), "near-prints")
    named = prints.select("id", "print")
    first = written(named.groupBy("print").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c"), "equal-prints")
    copies = written(named.join(first, "print").where("id <> b").select(F.col("id").alias("a"), "b"), "copies")
    single = prints.join(copies.select(F.col("a").alias("id")), "id", "left_anti")
    filed = written(filed_nodes(single, split), "filed")
    bits = single.select("id", "n", "bits")

    def links_of(node, part, i, n, b):
        sure, clusters = node_links(i, n, _bits(b), similarity)
        a, c = _columns(sure + clusters, (np.int64, np.int64))
        return [np.full(len(a), node[0]), np.full(len(a), part[0]), a, c, np.arange(len(a)) < len(sure)]

    dealt = filed.join(bits, "id").select("node", "part", F.col("node").alias("node_"), F.col("part").alias("part_"), "id", "n", "bits")
    links = _by_group(dealt, ["node", "part"], links_of, ["node", "part", "a", "b", "sure"], "node long, part int, a long, b long, sure boolean", "near-links", filed.count())
    count, changed = links.count(), copies.count()
    # one sure link of each text to a smaller id spans about what all sure links do
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    spanning = links.where("sure").select(*pair).groupBy("b").agg(F.min_by("a", F.xxhash64("a", "b")).alias("a")).select("a", "b")
    roots = connected_components(copies, changed)
    clusters = links.where("not sure").select("node", "part", F.col("b").alias("cluster"), F.col("a").alias("id"))
    split_nodes = filed.join(filed.where("part > 0").select("node").distinct(), "node").select("node", "id")
    sets = _sets(light, clusters.select("id").union(split_nodes.select("id")), words, count + split_nodes.count())
    roots = _grown(roots, spanning, sets, similarity, count)
    open_ = _mixed_groups(_with_roots(clusters, roots), ["node", "part", "cluster"])
    partners = _by_group(
        open_.join(bits, "id").select("node", "part", "cluster", "id", "n", "bits", "root"), ["node", "part", "cluster"],
        lambda i, n, b, r: best_partners(i, n, _bits(b), r, similarity), ["a", "b"], "a long, b long", "partners", count,
    )
    roots = _grown(roots, partners.select(*pair), sets, similarity, count)
    return _settled(roots, clusters, split_nodes, single, sets, similarity, split)


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of texts that links of the similarity hold together, with the input's columns.

    The row with the smallest id stays, nulls last, the first read of rows with
    one id.  Null and empty texts have no shingles and form one group.  Texts
    shorter than a shingle are alike when all their words are equal.  An empty
    table gives no rows.
    """
    numbered = written(docs.select(F.struct(*[col(c) for c in docs.columns]).alias(ROW), F.monotonically_increasing_id().alias(RID)), "documents")
    light = numbered.select(F.col(RID).alias("id"), F.coalesce(F.col(f"{ROW}.{quoted(text)}").cast("string"), F.lit("")).alias("text"))
    roots = near_components(light, **options)
    members = roots.select(F.col("node").alias("id"), "root").union(roots.select(F.col("root").alias("id"), "root").distinct())
    ids = numbered.select(F.col(RID).alias("id"), F.col(f"{ROW}.{quoted(doc_id)}").alias("own"))
    most = 2 * roots.count()
    owned = written(members.join(ids, "id"), "owned", most=most)
    order = F.struct(F.col("own").isNull().alias("none"), F.col("own"), F.col("id"))
    best = written(owned.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.id").alias("stays")), "groups", most=most)
    gone = owned.join(best, "root").where("id <> stays").select(F.col("id").alias(RID))
    return unpacked(numbered.join(written(gone, "dropped", most=most), RID, "left_anti"))  # the smaller side: whole rows move only if it is large
