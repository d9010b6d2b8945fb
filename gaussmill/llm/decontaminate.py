"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the k-gram hashes in each window of `window` consecutive words (k is half the
window) the smallest is kept, with its position.  Adjacent windows mostly keep
the same one, so about 2 of every 7 positions are fingerprints, and every span
of a window or more that a document shares with an item holds a fingerprint of
both at one place in it.  Fingerprints of documents and items are joined, and
each hit is extended word by word, to both sides as far as a window can reach;
what has the length of a window is a shared span.  Items shorter than a window
are windows of their own length.

The fingerprints of the items also fill a bitmap of bounded size that travels
as a literal.  It only keeps fingerprints from the join that can't match;
however full it is, the result is the same.

Joined rows carry the number of a context (a fingerprint of items with the words
around it), not the items; items are looked up for each document at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import ROW, RID, col, quoted, text_of, unpacked, written

WINDOW = 10
#: Bitmap sizes in 64-bit words, and the bytes of text up to which the table of the items' contexts may be broadcast.
LEAST_BITMAP, MOST_BITMAP, MOST_BROADCAST = 1 << 12, 1 << 16, 16 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it in `body`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def words_of(text: Column) -> Column:
    """Words of a text, only A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
    return F.regexp_extract_all(lowered, F.lit("[^" + NOT_WORD[1:] + "+"), F.lit(0))


def _zip(a: str, b: str, skip: int, size: str, body: str) -> str:
    """SQL: body(x, y) of a[i] and b[i + skip], for `size` values of i."""
    return f"zip_with(slice({a}, 1, greatest(0, {size})), slice({b}, {skip + 1}, greatest(0, {size})), (x, y) -> {body})"


def _chain(base: str, span: int, size: str, body: str, name: str, use) -> str:
    """SQL of use(v), v[i] the combination of base[i] to base[i + span - 1], for `size` values of i; by doubling."""

    def step(have: str, covered: int) -> str:
        if covered == span:
            return use(have)
        add = min(covered, span - covered)
        part, new = (have, covered) if add == covered else (base, 1)
        grown = covered + new
        length = f"{size} + {span - grown}"
        return let(f"{name}{grown}", _zip(have, part, covered, length, body), step(f"{name}{grown}", grown))

    return step(base, 1)


def _gram(n: int) -> int:
    """Words in a gram of a window of n words."""
    return max(1, n // 2)


def _fingerprints(words: str, n: int, test: str) -> str:
    """SQL: array<struct<len, fp, at, gram, l, r>> of the fingerprints of `words` that pass a test of f: the smallest gram hash of each
    window of n words, its place, its words, and the words before (nearest first) and after it that a window with it can reach."""
    k = _gram(n)
    rest, count = n - k, f"(size({words}) - {n - 1})"

    def kept(g: str, m: str) -> str:
        passing = f"filter(transform({m}, (f, j) -> if({test}, struct(f as f, j as j), null)), p -> p is not null)"
        places = f"array_distinct(flatten(transform({passing}, p -> filter(sequence(p.j, p.j + {rest}), i -> {g}[i] = p.f))))"
        gram = f"array_join(slice({words}, i + 1, {k}), ' ') as gram"
        around = f"reverse(slice({words}, greatest(i - {rest}, 0) + 1, least(i, {rest}))) as l, slice({words}, i + {k + 1}, {rest}) as r"
        return f"transform({places}, i -> struct({n} as len, {g}[i] as fp, i as at, {gram}, {around}))"

    chain = _chain("h", k, f"({count} + {rest})", "xxhash64(x, y)", "g", lambda g: _chain(g, rest + 1, count, "least(x, y)", "m", lambda m: kept(g, m)))
    return let("h", f"transform({words}, z -> xxhash64(z))", chain)


def _probes(size: int) -> list[tuple[str, str]]:
    return [(f"cast(f & {size - 1} as int)", "cast(shiftrightunsigned(f, 16) & 63 as int)"), (f"cast(shiftrightunsigned(f, 22) & {size - 1} as int)", "cast(shiftrightunsigned(f, 38) & 63 as int)")]


def item_contexts(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Rows (cid, len, fp, gram, l, r, ids): each distinct fingerprint of the items with the words around it, and the ids of its items."""
    rows = items.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("id"), words_of(text_of(text)).alias("w")).where("size(w) > 0")
    own = None
    for n in range(1, window + 1):
        found = F.expr(_fingerprints("w", n, "true"))
        here = F.least(F.size("w"), F.lit(window)) == n
        own = F.when(here, found) if own is None else own.when(here, found)
    each = rows.select("id", F.explode(own).alias("c")).select("id", "c.*")
    grouped = each.groupBy("len", "fp", "gram", "l", "r").agg(F.collect_set("id").alias("ids"))
    return written(grouped.withColumn("cid", F.monotonically_increasing_id()), "item-contexts")


def _bitmap(contexts: DataFrame) -> tuple[int, str]:
    prints = contexts.select(F.col("fp").alias("f")).distinct()
    size, count = LEAST_BITMAP, prints.count()
    while size < MOST_BITMAP and size < count:
        size *= 2
    marks = prints.select(F.explode(F.expr("array(" + ", ".join(f"struct({i} as i, {b} as b)" for i, b in _probes(size)) + ")")).alias("p"))
    rows = marks.groupBy("p.i").agg(F.expr("bit_or(shiftleft(1L, p.b))").alias("v")).collect()  # at most `size` rows
    held = dict.fromkeys(range(size), 0) | {r["i"]: r["v"] for r in rows}
    return size, "cast(split('" + ",".join(str(held[i]) for i in range(size)) + "', ',') as array<bigint>)"


def _candidates(contexts: DataFrame) -> Column:
    """A column of the fingerprints of `w` that pass the bitmap, for each length of item windows."""
    found = ["cast(array() as array<struct<len int, fp bigint, at int, gram string, l array<string>, r array<string>>>)"]
    for n in sorted(r["len"] for r in contexts.select("len").distinct().collect()):  # at most `window` rows
        size, bits = _bitmap(contexts.where(F.col("len") == n))
        found.append(_fingerprints("w", n, " and ".join(f"getbit({bits}[{i}], {b}) = 1" for i, b in _probes(size))))
    return F.expr(f"concat({', '.join(found)})")


def _reach(a: str, b: str) -> str:
    """SQL: the number of leading words that two arrays share."""
    step = "struct(s.go and same as go, s.n + int(s.go and same) as n)"
    return f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), struct(true as go, 0 as n), (s, same) -> {step}, s -> s.n)"


COVERED = "aggregate(sort_array(spans), struct(0 as upto, 0L as n), (a, s) -> struct(greatest(a.upto, s.at + s.len) as upto, a.n + greatest(0, s.at + s.len - greatest(a.upto, s.at)) as n), a -> a.n)"


def _found(docs: DataFrame, items: DataFrame, *, carry: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, rid, n_words) of all documents, rows (rid, at, len, cid) of the spans that they share with contexts, and the contexts."""
    contexts = item_contexts(items, item_id, item_text, window)
    held = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[col(c) for c in held]).alias(ROW), words_of(text_of(text)).alias("w"))
    base = written(rows.select(ROW, F.monotonically_increasing_id().alias(RID), F.size("w").cast("long").alias("n_words"), _candidates(contexts).alias("found")), "documents")
    cells = base.select(RID, F.explode("found").alias("c")).select(RID, "c.*")
    side = contexts.select("cid", "len", "fp", "gram", F.col("l").alias("il"), F.col("r").alias("ir"))
    around = F.expr("octet_length(gram) + octet_length(array_join(l, '')) + octet_length(array_join(r, ''))")
    if (contexts.agg(F.sum(around + 64)).first()[0] or 0) <= MOST_BROADCAST:
        side = F.broadcast(side)
    grams = F.greatest(F.expr("len div 2"), F.lit(1))
    joined = cells.join(side, ["len", "fp", "gram"]).select(RID, "at", "cid", "len", F.expr(_reach("l", "il")).alias("before"), F.expr(_reach("r", "ir")).alias("after"), grams.alias("k"))
    spans = joined.where("before + k + after >= len").select(RID, (F.col("at") - F.col("before")).cast("int").alias("at"), (F.col("before") + F.col("k") + F.col("after")).cast("int").alias("len"), "cid")
    return base.drop("found"), spans, contexts


def hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows (row, n_words, n_hit, ids, spans), one for each document row.

    n_hit counts the words inside any occurrence of an item's window, ids are
    the sorted ids of those items, spans what was found (start word and length,
    each at least a window, together all occurrences).  Null and empty texts have no words.  A null item id counts as an
    empty string; rows with one item id are one item.  Empty tables are fine.
    """
    base, spans, contexts = _found(docs, items, **options)
    spans = written(spans, "shared-spans")
    per_row = spans.select(RID, F.struct("at", "len").alias("span")).distinct().groupBy(RID).agg(F.collect_list("span").alias("spans"))
    own = spans.select(RID, "cid").distinct().join(contexts.select("cid", F.explode("ids").alias("id")), "cid").select(RID, "id").distinct()
    own = own.groupBy(RID).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    out = base.join(per_row.select(RID, F.expr(COVERED).alias("n_hit"), "spans").join(own, RID), RID, "left")
    return out.select(ROW, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "spans")


def contamination_report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, carry=[doc_id], **options)
    return found.select(
        F.col(f"{ROW}.{quoted(doc_id)}").alias("doc_id"), "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows without any word inside a window of an item, with the input's columns."""
    base, spans, _ = _found(docs, items, **options)
    gone = written(spans.select(RID).distinct(), "dropped")  # the smaller side: whole rows move only if it is large
    return unpacked(base.join(gone, RID, "left_anti"))
