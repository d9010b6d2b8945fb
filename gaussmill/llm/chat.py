"""Chat formatting with linked tool calls.

A message is one row (conversation, turn, role, text).  A text that is a JSON
object with a list `tool_calls` of objects {id, name, arguments, after?} makes
calls; a message of role `tool` whose text is a JSON object with
`tool_call_id` carries a result.  Every other text is plain content.

Calls and results are joined by (conversation, identifier).  A result comes
after its call and a call after the results it names in `after`: the order of
messages is the topological order nearest to the turns.  Arguments are checked
against JSON schemas, and each message becomes canonical JSON: sorted keys, no
spaces, UTF-8.

What JSON can't hold, or this module not write, is no call and no result but
plain content: NaN and infinite numbers, more than `DEEPEST` nested values.
Surrogates without a partner become U+FFFD.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import RID, col, is_empty, map_batches, written

TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
DEEPEST = 100


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _writable(value, depth: int = 0):
    """The value with whole characters only; ValueError if it can't be written as JSON."""
    if depth > DEEPEST:
        raise ValueError("nested too deeply")
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, dict):
        return {_writable(k): _writable(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [_writable(v, depth + 1) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not a JSON number")
    return value


def loaded(text: str):
    """The value of a JSON text; ValueError if it is none."""
    try:
        return _writable(json.loads(text))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def _is(value, kind) -> bool:
    if isinstance(kind, list):
        return any(_is(value, k) for k in kind)
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return not isinstance(kind, str) or isinstance(value, TYPES.get(kind, object))


def problems(value, schema, at: str = "$") -> list[str]:
    """What of a value its schema forbids: type (a name or a list of names), enum, required, properties, additionalProperties, items.

    A schema may be true or false: anything goes, nothing goes.
    """
    if not isinstance(schema, dict):
        return [f"{at}: not allowed"] if schema is False else []
    kind, out = schema.get("type"), []
    if not _is(value, kind):
        return [f"{at}: not of type {' or '.join(kind) if isinstance(kind, list) else kind}"]
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif others is False:
                out.append(f"{at}.{k}: unknown")
            else:
                out += problems(value[k], others, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def parsed(role: str | None, text: str | None) -> tuple[str, list[dict], dict]:
    """Kind (plain, calls or result), calls, result."""
    if text and text.lstrip()[:1] == "{" and ("tool_calls" in text or role == "tool"):
        try:
            value = loaded(text)
        except ValueError:
            return "plain", [], {}
        calls = value.get("tool_calls")
        if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
            return "calls", calls, {}
        if role == "tool" and isinstance(value.get("tool_call_id"), str):
            return "result", [], value
    return "plain", [], {}


def arguments_of(call: dict):
    """Arguments as a value: models often give them as a JSON text."""
    given = call.get("arguments", {})
    if isinstance(given, str):
        try:
            return loaded(given)
        except ValueError:
            return given
    return given


def _names(after) -> list:
    return after if isinstance(after, list) else []


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rid, conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind, calls, result = parsed(role, text)
            out += [(rid, conv, turn, "call", c["id"]) for c in calls]
            out += [(rid, conv, turn, "after", x) for c in calls for x in _names(c.get("after")) if isinstance(x, str)]
            if kind == "result":
                out.append((rid, conv, turn, "result", result["tool_call_id"]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [batch.schema.field(0).type, batch.schema.field(1).type, batch.schema.field(2).type, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rid", "conv", "turn", "what", "id"])


def _chains(single: DataFrame) -> DataFrame:
    """Rows (rid, head, most, length, tail) of rows (rid, up, turn), each message with the one it depends on.

    head is the nearest message on the way up that is no `rid` itself; most is
    the latest turn on the way down from it, which `length` messages make and
    `tail` messages follow.  By pointer doubling: as many rounds as the longest
    way has binary digits.  Messages on and below a cycle have no head and are
    left out.
    """
    now, done, left = written(single.select("rid", "up", F.col("turn").alias("most"), F.lit(1).alias("length"), F.lit(0).alias("tail")), "chains"), None, None
    while True:
        upper = now.select(F.col("rid").alias("up"), F.col("up").alias("up2"), F.col("most").alias("most2"), F.col("length").alias("length2"), F.col("tail").alias("tail2"))
        earlier = F.col("up2").isNotNull() & (F.col("most2") >= F.col("most"))
        both = now.join(upper, "up", "left").select(
            "rid", F.coalesce("up2", "up").alias("up"), F.greatest("most", "most2").alias("most"), (F.col("length") + F.coalesce("length2", F.lit(0))).alias("length"),
            F.when(earlier, F.col("tail2") + F.col("length")).otherwise(F.col("tail")).alias("tail"), F.col("up2").isNull().alias("done"),
        )
        now = written(both, "chains")
        count = now.where("not done").count()
        if not count or count == left:
            return now.where("done").select("rid", F.col("up").alias("head"), "most", "length", "tail")
        left, now = count, now.drop("done")


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (rid, order_turn, depth) from nodes (rid, turn) and edges (src, dst).

    A message's turn in the order is the latest of its own and those it depends
    on; depth ranks messages that fall on one turn.  Messages that depend on one
    other make chains, which are solved whole (see _chains); a round solves
    those that depend on several, all of them solved, and the chains below.  What
    is left at the end is part of a cycle or below one, and keeps its own turn.
    """
    least = -(1 << 63)
    edges = written(edges.where("src <> dst").distinct(), "edges")
    own = nodes.select("rid", F.coalesce("turn", F.lit(least)).alias("turn"))
    degree = written(edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up")), "degrees")
    single = degree.where("n = 1").select(F.col("dst").alias("rid"), "up").join(own, "rid")
    chains = _chains(single)
    several = edges.join(degree.where("n > 1").select("dst"), "dst")

    def below(heads: DataFrame) -> DataFrame:
        top = heads.select(F.col("rid").alias("head"), F.col("order_turn").alias("t"), F.col("depth").alias("d"))
        solved = chains.join(top, "head").select("rid", F.greatest("t", "most").alias("order_turn"), F.expr("if(t >= most, d + length, tail)").alias("depth"))
        return heads.unionByName(solved)

    free = own.join(degree.select(F.col("dst").alias("rid")), "rid", "left_anti").select("rid", F.col("turn").alias("order_turn"), F.lit(0).alias("depth"))
    solved = written(below(free), "order")
    while not is_empty(several):
        source = solved.select(F.col("rid").alias("src"), "order_turn", "depth")
        waiting = several.join(solved.select(F.col("rid").alias("dst")), "dst", "left_anti").join(source, "src", "left")
        ready = waiting.groupBy("dst").agg(F.count("*").alias("all"), F.count("depth").alias("there"), F.max(F.struct("order_turn", "depth")).alias("last")).where("all = there")
        new = ready.select(F.col("dst").alias("rid"), "last").join(own, "rid").select("rid", F.greatest("turn", "last.order_turn").alias("order_turn"), F.expr("if(last.order_turn >= turn, last.depth + 1, 0)").alias("depth"))
        new = written(new, "order")
        if is_empty(new):
            break
        solved = written(solved.unionByName(below(new)), "order")
    found = solved.select("rid", F.when(F.col("order_turn") != least, F.col("order_turn")).alias("order_turn"), "depth")
    rest = nodes.join(solved, "rid", "left_anti").select("rid", F.col("turn").alias("order_turn"), F.lit(0).alias("depth"))
    return found.unionByName(rest)


def format_messages(messages: DataFrame, schemas: dict[str, dict] | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, order_turn, depth, kind, n_calls, n_problems, message (canonical JSON).

    Within a conversation, sort by (order_turn, depth, turn).  Of calls with one
    identifier the first counts, as of results; later ones are marked as
    repeated.  Results without a call are orphans, calls without a result
    unanswered, both kept.  Null texts and roles become JSON null; null
    conversations are one conversation.  Repeated rows are messages of their
    own, with repeated calls.  An empty table gives no rows.  Long texts are
    formatted whole; long conversations are never gathered in one task.
    """
    rows = written(messages.select(F.monotonically_increasing_id().alias(RID), col(conv).alias("conv"), col(turn).cast("long").alias("turn"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text")), "messages")
    tooled = rows.where("(role = 'tool' or text like '%tool_calls%') and text like '%{%'")
    links = written(map_batches(tooled, _links, f"rid long, conv {dict(rows.dtypes)['conv']}, turn long, what string, id string"), "links")
    if is_empty(links):
        state = rows.withColumns({"order_turn": F.col("turn"), "depth": F.lit(0), "linked": F.expr("cast(array() as array<string>)")})
    else:
        first = links.where("what <> 'after'").groupBy("conv", "id", "what").agg(F.min(F.struct("turn", RID)).alias("first")).select("conv", "id", "what", F.col("first.rid").alias(RID))
        first = written(first, "first")
        call, result = (first.where(f"what = '{k}'").select(F.col("conv").alias(f"c_{k}"), F.col("id").alias(f"i_{k}"), F.col(RID).alias(k)) for k in ("call", "result"))
        pairs = written(call.join(result, call["c_call"].eqNullSafe(result["c_result"]) & (call["i_call"] == result["i_result"])).select(F.col("i_call").alias("id"), "call", "result", F.col("c_call").alias("conv")), "pairs")
        after = links.where("what = 'after'").select(F.col("conv").alias("a_conv"), F.col("id").alias("a_id"), F.col(RID).alias("dst"))
        needs = after.join(pairs, after["a_conv"].eqNullSafe(pairs["conv"]) & (after["a_id"] == pairs["id"])).select(F.col("result").alias("src"), "dst")
        edges = written(pairs.select(F.col("call").alias("src"), F.col("result").alias("dst")).unionByName(needs), "edges")
        touched = edges.select(F.col("src").alias(RID)).union(edges.select("dst")).distinct()
        order = written(ordered(written(rows.select(RID, "turn").join(touched, RID, "left_semi"), "nodes"), edges), "order")
        both = pairs.select(F.col("call").alias(RID), F.concat(F.lit("c"), "id").alias("x")).union(pairs.select("result", F.concat(F.lit("r"), "id")))
        both = both.union(first.select(RID, F.concat(F.lit("f"), "id")))
        linked = both.groupBy(RID).agg(F.collect_set("x").alias("linked"))
        state = rows.join(order, RID, "left").join(linked, RID, "left").withColumns({"order_turn": F.coalesce("order_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    schemas = schemas or {}

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, counts, bad, made = [], [], [], []
            for role_, text_, linked_ in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True):
                kind, calls, result = parsed(role_, text_)
                held, wrong = set(linked_ or ()), 0
                if kind == "calls":
                    out = []
                    for c in calls:
                        found = problems(arguments_of(c), schemas[c["name"]]) if c["name"] in schemas else ["$: no schema"] if schemas else []
                        status = "repeated" if "f" + c["id"] not in held else "answered" if "c" + c["id"] in held else "unanswered"
                        out.append({"arguments": arguments_of(c), "id": c["id"], "name": c["name"], "status": status, **({"problems": found} if found else {})})
                        wrong += bool(found) + (status == "repeated")
                    message = {"role": role_, "tool_calls": out}
                elif kind == "result":
                    i = result["tool_call_id"]
                    status = "linked" if "r" + i in held else "repeated" if "f" + i not in held else "orphan"
                    wrong += status != "linked"
                    message = {"content": result.get("content"), "role": role_, "status": status, "tool_call_id": i}
                else:
                    message = {"content": text_, "role": role_}
                kinds.append(kind)
                counts.append(len(calls))
                bad.append(wrong)
                made.append(canonical(message))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kinds, pa.string()), pa.array(counts, pa.int64()), pa.array(bad, pa.int64()), pa.array(made, pa.string())], names=["conv_id", "turn", "order_turn", "depth", "kind", "n_calls", "n_problems", "message"])

    rows = state.select("conv", "turn", "order_turn", "depth", "role", "text", "linked")
    return map_batches(rows, render, f"conv_id {dict(rows.dtypes)['conv']}, turn long, order_turn long, depth int, kind string, n_calls long, n_problems long, message string")
