"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

Pages are grouped by host.  A line that more than `ratio` of a host's pages and
at least `least_repeats` of them contain is boilerplate there and is dropped
from those pages.  Hosts with fewer than `least_pages` pages give no evidence
and keep everything.

Lines are counted by a 64-bit key of host and line.  Only lines whose key's
count passes are counted again by their contents, so that a shared key can't
drop a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import ROW, RID, col, is_empty, quoted, written

RATIO, LEAST_PAGES, LEAST_REPEATS = 0.3, 3, 2
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: HTML to text: what is not shown, then tags that end a line, then all others.
HIDDEN = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|tr|table|article|section|header|footer|head|body|title|html)(?:[^A-Za-z>][^>]*)?>"
TAGS = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty for null and for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def html_text(html: Column) -> Column:
    """Text of an HTML page with a line for each block."""
    shown = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAGS, "")


def lines_of(text: Column) -> Column:
    """Lines without white space at their ends; empty ones are no lines."""
    return F.filter(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "[\n\r]+"), lambda x: F.regexp_replace(x, r"^[\x20\t]+|[\x20\t]+$", "")), lambda x: x != "")


def dedup_lines(
    pages: DataFrame, url: Column, text: Column, *, carry: list[str] | None = None, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_repeats: int = LEAST_REPEATS, key_bits: int = 64
) -> DataFrame:
    """Rows (row, host, lines, kept), one for each page row: its lines, and those that stay, in order.

    A page counts once for a line however often it holds it, and loses all of
    its copies.  Pages without a host form one group, the empty host.  Null
    texts have no lines; repeated rows are pages of their own; an empty table
    gives no rows; pages and lines may have any length.  `key_bits` below 64
    exists to test lines that share a key.
    """
    held = pages.columns if carry is None else carry
    rows = pages.select(F.struct(*[col(c) for c in held]).alias(ROW), F.monotonically_increasing_id().alias(RID), host_of(url).alias("host"), lines_of(text).alias("lines"))
    key = "xxhash64(host, x)" if key_bits == 64 else f"xxhash64(host, x) & {(1 << key_bits) - 1}L"
    base = written(rows.withColumn("keys", F.expr(f"transform(lines, x -> {key})")), "pages")
    totals = base.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    passes = (F.col("with_line") >= least_repeats) & (F.col("with_line") / F.col("pages") > ratio)
    # by key: at least the count of any line with it; hosts that share a key or a hash count as the smallest
    counts = base.select(F.xxhash64("host").alias("lo"), F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("with_line"), F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    sizes = totals.groupBy(F.xxhash64("host").alias("lo")).agg(F.min("pages").alias("pages"))
    maybe = counts.where(F.col("with_line") >= least_repeats).join(sizes, "lo", "left").where(passes | (F.col("lo") != F.col("hi"))).select("key")
    maybe = written(maybe, "frequent-keys")
    each = base.select("host", F.explode(F.array_distinct("lines")).alias("x")).select("host", F.expr(key).alias("key"), F.col("x").alias("line")).join(maybe, "key")
    lines = written(each.groupBy("key", "host", "line").agg(F.count("*").alias("with_line")), "frequent-lines")
    alone = lines.groupBy("key").agg((F.count("*") == 1).alias("alone"))
    dropped = written(lines.join(totals, "host").where(passes).join(alone, "key").select("key", F.when(~F.col("alone"), F.col("host")).alias("its_host"), F.when(~F.col("alone"), F.col("line")).alias("its_line")), "boilerplate")
    shared = dropped.where("its_line is not null")
    at = base.select(RID, F.posexplode("keys").alias("at", "key")).join(dropped.where("its_line is null").select("key"), "key").select(RID, "at")
    if not is_empty(shared):
        cells = base.select(RID, "host", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("lines").alias("line"))).alias("at", "x")).select(RID, "host", "at", "x.key", "x.line")
        at = at.unionByName(cells.join(shared, "key").where("host = its_host and line = its_line").select(RID, "at"))
    gone = at.groupBy(RID).agg(F.collect_list("at").alias("gone"))
    stays = "transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])"
    return base.join(gone, RID, "left").select(ROW, "host", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.expr(stays)).alias("kept"))


def boilerplate_report(pages: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_kept, text_sha256 (of the lines that stay, joined by line feeds)."""
    found = dedup_lines(pages, col("url"), html_text(col("html")), carry=["page_id"])
    return found.select(
        F.col(f"{ROW}.{quoted('page_id')}").alias("page_id"), "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("text_sha256")
    )
