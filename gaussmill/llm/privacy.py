"""Personal data and what gives it away, in DataFrame operations only.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and phone
numbers, found by patterns over whole texts.  The values of these spans are the
protected entities.  For each entity e and each term t of the whole documents
that hold it, corpus counts give

    PMI(e; t) = log2(n(e, t) N / (n(e) n(t)))    IC(e) = log2(N / n(e))

(numbers of documents; N all documents, n(t) over the whole corpus).  PMI / IC
is the share of e's information that t discloses; 1 means that t occurs only
with e.  A term whose share reaches `remove` is removed from the documents that
hold the entity, wherever it stands there, one that reaches `generalise` is
replaced by its class.  Terms with fewer than `support` common documents are no
evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import ROW, RID, col, is_empty, quoted, text_of, written
from gaussmill.llm.decontaminate import let

GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 3

#: Leftmost matches of each kind.  Possessive forms and look-behinds match what the plain patterns do, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be looked for at all.
NEEDED = {"email": "text like '%@%'", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][ -]?[0-9]'", "phone": "text like '%+%'"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = "aggregate(transform(sequence(1, length(d)), i -> int(substr(d, length(d) + 1 - i, 1)) * (2 - i % 2)), 0, (a, x) -> a + x - if(x > 9, 9, 0)) % 10 = 0"
VALID = {
    "email": "true",
    "ip": rf"m rlike '^(?:{OCTET}\\.){{3}}{OCTET}$'",
    "card": f"length({DIGITS}) between 13 and 19 and {let('d', DIGITS, LUHN)}",
    "phone": f"length({DIGITS}) between 9 and 15",
}
VALUE = {"email": "lower(m)", "ip": "m", "card": DIGITS, "phone": DIGITS}
#: The distinct words of a text, in lower case.
WORDS = r"array_distinct(transform(filter(split(text, '[^\\p{L}]+'), x -> length(x) >= 3), x -> lower(x)))"
#: A word that is no part of an address; and where a word may end.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?!\.?[\p{L}\p{N}@_%+-])"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cumulative(values: str) -> str:
    """SQL of the running sums of an int array, in blocks of about the square root of its size: n^1.5 steps."""
    block = f"greatest(16, cast(sqrt(size({values})) as int))"
    cut = f"slice({values}, b * {block} + 1, {block})"
    own = f"aggregate({cut}, array(a.base), (c, x) -> array_append(c, element_at(c, size(c)) + x), c -> slice(c, 2, size(c) - 1))"
    step = f"struct(array_append(a.done, {own}) as done, aggregate({cut}, a.base, (c, x) -> c + x) as base)"
    return f"aggregate(sequence(0, (size({values}) - 1) div {block}), struct(cast(array() as array<array<int>>) as done, 0 as base), (a, b) -> {step}, a -> flatten(a.done))"


def matches(text: str, pattern: str) -> str:
    """SQL: array<struct<s, n, m>> of a pattern's matches: start and end in code points, match."""
    p = _literal(pattern)
    starts = "transform(ms, (x, i) -> length(ps[i]) + if(i > 0, length(ms[i - 1]), 0))"
    whole = f"transform(ms, (m, i) -> struct(ss[i] as s, ss[i] + length(m) as n, m as m))"
    return let("ms", f"regexp_extract_all({text}, {p}, 0)", let("ps", f"split({text}, {p}, -1)", let("ls", starts, let("ss", cumulative("ls"), whole))))


def base_spans(kind: str) -> Column:
    """Valid spans of a kind in `text`; matches that fail are dropped, without another try inside them."""
    found = f"transform(filter({matches('text', PATTERNS[kind])}, x -> {let('m', 'x.m', VALID[kind])}), x -> struct('{kind}' as kind, x.s as s, x.n as n, concat('{kind}:', {let('m', 'x.m', VALUE[kind])}) as e))"
    empty = "cast(array() as array<struct<kind string, s int, n int, e string>>)"
    return F.expr(f"if({NEEDED[kind]}, {found}, {empty})")


def analyse(docs: DataFrame, text: str = "text", *, carry: list[str] | None = None, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """Rows (row, base, added), one for each input row: base spans, and spans of disclosing terms with their action.

    A null text is empty and has no spans.  Repeated rows count as documents
    each.  An empty table gives no rows.
    """
    held = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[col(c) for c in held]).alias(ROW), text_of(text).alias("text"))
    found = rows.select(ROW, F.monotonically_increasing_id().alias(RID), F.concat(*[base_spans(k) for k in PATTERNS]).alias("base"), "text")
    entities = F.array_distinct(F.expr("transform(base, x -> x.e)")).alias("entities")
    spans = written(found.select(ROW, RID, F.expr("transform(base, x -> struct(x.kind, x.s, x.n))").alias("base"), entities, F.expr("if(size(base) > 0, text, null)").alias("text")), "spans")
    total = spans.count()
    each = spans.select(RID, F.explode("entities").alias("e"))
    per_entity = written(each.groupBy("e").agg(F.count("*").alias("ne")).where(F.col("ne").between(support, total - 1)), "entities")
    held = written(each.join(per_entity.select("e"), "e").select(RID, "e"), "held-entities")
    sets = held.groupBy(RID).agg(F.collect_list("e").alias("es"))
    pairs = spans.where("text is not null").select(RID, F.expr(WORDS).alias("ts")).join(sets, RID).select(F.explode("es").alias("e"), "ts").select("e", F.explode("ts").alias("t"))
    joint = written(pairs.groupBy("e", "t").agg(F.count("*").alias("both")).where(F.col("both") >= support), "joint-counts")
    if is_empty(joint):
        return spans.select(ROW, "base", F.expr("cast(array() as array<struct<s int, n int, action string>>)").alias("added"))
    words = rows.select(F.explode(F.expr(WORDS)).alias("t")).groupBy("t").agg(F.count("*").alias("nt"))
    share = F.log2(F.col("both") * total / (F.col("ne") * F.col("nt"))) / F.log2(total / F.col("ne"))
    told = joint.join(per_entity, "e").join(words, "t").select("e", "t", F.when(share >= remove, "removed").when(share >= generalise, "generalised").alias("action")).where("action is not null")
    told = written(told, "disclosing-terms")
    masks = written(held.join(told, "e").groupBy(RID, "t").agg(F.max("action").alias("action")), "masks")
    terms = spans.where("text is not null").join(masks.select(RID).distinct(), RID, "left_semi").select(RID, F.explode(F.expr(matches("text", TERM))).alias("x")).select(RID, F.lower("x.m").alias("t"), "x.s", "x.n")
    added = terms.join(masks, [RID, "t"]).groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("s", "n", "action"))).alias("added"))
    return spans.join(added, RID, "left").select(ROW, "base", F.coalesce("added", F.expr("cast(array() as array<struct<s int, n int, action string>>)")).alias("added"))


def privacy_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans (base kinds as listed, then terms; code points)."""
    found = analyse(docs, text, carry=[doc_id], **options)
    base = F.expr("transform(base, x -> concat_ws(':', x.kind, x.s, x.n))")
    terms = F.expr("transform(added, x -> concat_ws(':', 'term', x.s, x.n))")
    return found.select(
        F.col(f"{ROW}.{quoted(doc_id)}").alias("doc_id"),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in PATTERNS],
        F.size("added").cast("long").alias("n_term"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows with base spans replaced by [EMAIL], [IP], [CARD] or [PHONE], and terms generalised to [TERM] or removed.

    Overlapping spans are replaced together, by the mark of the one that begins
    first (of equals, the kind listed first).  Texts without spans stay as they
    are, null ones null.
    """
    found = analyse(docs, text, **options)
    marks = "array_sort(concat(transform(base, x -> struct(x.s as s, x.n as n, concat('[', upper(x.kind), ']') as mark)), transform(added, x -> struct(x.s as s, x.n as n, if(x.action = 'removed', '', '[TERM]') as mark))))"
    t = f"{ROW}.{quoted(text)}"
    step = f"if(x.s < a.upto, struct(greatest(a.upto, x.n) as upto, a.out as out), struct(x.n as upto, concat(a.out, array(substr({t}, a.upto + 1, x.s - a.upto), x.mark)) as out))"
    new = f"aggregate({marks}, struct(0 as upto, cast(array() as array<string>) as out), (a, x) -> {step}, a -> concat(array_join(a.out, ''), substr({t}, a.upto + 1)))"
    changed = F.when((F.size("base") + F.size("added") > 0) & F.expr(f"{t} is not null"), F.expr(new)).otherwise(F.expr(t))
    return found.select(*[changed.alias(c) if c == text else F.col(f"{ROW}.{quoted(c)}") for c in docs.columns])
