"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gaussmill.llm import line_dedup, privacy, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.exact_dedup import duplicate_report

    return duplicate_report(table(spark, sf_dir, "documents"))


def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.privacy import privacy_report

    return privacy_report(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.sharding import shard_assignment

    return shard_assignment(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.line_dedup import boilerplate_report

    return boilerplate_report(table(spark, sf_dir, "pages"))


#: Schemas of the tools that `replay` calls.
TOOLS = {
    "measure": {"type": "object", "properties": {"chars": {"type": "integer"}, "lang": {"type": ["string", "null"]}}, "required": ["chars"], "additionalProperties": False},
    "look": {"type": "object", "properties": {"turn": {"type": "integer"}, "mode": {"enum": ["fast", "full"]}}, "required": ["turn"], "additionalProperties": False},
}


def replay(messages: DataFrame) -> DataFrame:
    """The table's conversations as tool calls: the table itself holds none.

    Conversation c becomes -1 - c.  The user's message of turn t calls c<t> and
    waits for the result of c<t-2>; the assistant's of turn t is the result of
    c<t-1>.  In every fourth conversation turns run backwards, so that order
    comes from the links alone.  In every fifth, call c2 is named x2, so that it
    has no result and its result no call.  Some arguments break their schema: texts of odd
    length give `chars` as a string, turns from 4 on an unknown mode.
    """
    turn = F.expr("if(conv_id % 4 = 0, -turn, turn)").alias("turn")
    arguments = F.expr("""if(turn < 2, concat('{"chars":', if(length(text) % 2 = 1, concat('"', length(text), '"'), string(length(text))), ',"lang":null}'),
        concat('{"mode":"', if(turn < 4, 'fast', 'slow'), '","turn":', turn, '}'))""")
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), F.expr("if(conv_id % 5 = 1 and turn = 2, 'x', 'c')"), F.col("turn"), F.expr("""if(turn < 2, '","name":"measure"', '","name":"look"')"""), F.lit(',"after":["c'), F.expr("turn - 2"), F.lit('"],"arguments":'), arguments, F.lit("}]}"))
    result = F.concat(F.lit('{"tool_call_id":"c'), F.expr("turn - 1"), F.lit('","content":'), F.length("text"), F.lit("}"))
    held = messages.where("role in ('user', 'assistant') and text is not null and turn is not null and conv_id is not null")
    return held.select((-1 - F.col("conv_id")).alias("conv_id"), turn, F.expr("if(role = 'user', 'assistant', 'tool')").alias("role"), F.when(F.col("role") == "user", call).otherwise(result).alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages, and their replay as tool calls."""
    from gaussmill.llm.chat import format_messages

    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_messages(messages.unionByName(replay(messages)), TOOLS)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.simhash import near_duplicate_report

    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gaussmill.llm.byte_bpe import round_trip_report

    return round_trip_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gaussmill.llm.sstable import shard_report

    return shard_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.llm.decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_dedup, op2_privacy, op3_quality_classifier, op4_extendible_sharding, op5_line_dedup, op6_chat_formatting, op7_simhash_near_dedup, op8_byte_bpe, op9_token_shards, op10_decontamination)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: The kinds of personal data as given: name, pattern, value of an entity, and what a match must pass.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "lower(m)", "TRUE"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "m", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INTEGER) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "digits", "length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CAST(substr('0246813579', 1 + CAST(x AS INTEGER), 1) AS INTEGER) * (1 - i % 2) + CAST(x AS INTEGER) * (i % 2))) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "digits", "length(digits) BETWEEN 9 AND 15"),
)


def matches_sql(pattern: str) -> str:
    """Rows (r, j, before, m, after, s) of the matches in `d`: the text before and after up to the next match, and the start."""
    parts = f"SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d"
    rows = f"SELECT r, unnest(range(len(ms))) AS j, unnest(ps[1:len(ms)]) AS before, unnest(ms) AS m, unnest(ps[2:len(ms) + 1]) AS after FROM ({parts})"
    return f"SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY r ORDER BY j) - length(m) AS s FROM ({rows})"


def privacy_sql() -> str:
    """Matches of the plain patterns, PMI / IC of the words beside them, and where disclosing words stand."""
    base = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, s, s + length(m) AS n, '{kind}:' || {value} AS e FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM ({matches_sql(pattern)})) WHERE {valid}"
        for k, (kind, pattern, value, valid) in enumerate(KINDS)
    )
    return rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), total AS (SELECT count(*) AS every FROM d),
        base AS MATERIALIZED ({base}), e AS (SELECT DISTINCT r, e FROM base),
        w AS MATERIALIZED (SELECT DISTINCT r, lower(x) AS t FROM (SELECT r, unnest(regexp_extract_all(text, '\p{{L}}+')) AS x FROM d) WHERE length(x) >= 3),
        ne AS (SELECT e, count(*) AS ne FROM e GROUP BY e HAVING count(*) >= {privacy.SUPPORT} AND count(*) < (SELECT every FROM total)),
        nt AS (SELECT t, count(*) AS nt FROM w GROUP BY t),
        joint AS (SELECT e.e, w.t, ne.ne, count(*) AS both_ FROM e JOIN ne ON e.e = ne.e JOIN w ON e.r = w.r GROUP BY e.e, w.t, ne.ne HAVING count(*) >= {privacy.SUPPORT}),
        told AS (SELECT e, joint.t FROM joint JOIN nt ON joint.t = nt.t, total WHERE log2(both_ * every / (ne * nt)) / log2(every / ne) >= {privacy.GENERALISE}),
        masks AS (SELECT DISTINCT e.r, told.t FROM e JOIN told ON e.e = told.e),
        runs AS (SELECT *, lead(m) OVER (PARTITION BY r ORDER BY j) AS next_ FROM ({matches_sql(r"\p{L}+")})),
        terms AS (SELECT runs.r, 9 AS k, 'term' AS kind, s, s + length(m) AS n FROM runs JOIN masks ON runs.r = masks.r AND lower(m) = masks.t
                  WHERE length(m) >= 3 AND NOT regexp_matches(before, '[\p{{N}}@._%+-]$') AND NOT regexp_matches(after, '^\.?[\p{{N}}@_%+-]') AND NOT (after = '.' AND next_ IS NOT NULL)),
        spans AS (SELECT r, k, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(n AS BIGINT) AS span FROM (SELECT r, k, kind, s, n FROM base UNION ALL SELECT * FROM terms)),
        g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "term"))}, string_agg(span, ',' ORDER BY k, s) FILTER (k < 9) AS own, string_agg(span, ',' ORDER BY k, s) AS spans FROM spans GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone", "term"))}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.r = g.r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
            SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
            FROM t WINDOW g AS (PARTITION BY h)""",
        "op2_privacy": privacy_sql(),
        "op4_extendible_sharding": f"""
            WITH t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b, lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
            l AS (SELECT doc_id, g.k AS depth, substr(bits, 1, g.k) AS shard, sum(b) OVER w AS shard_bytes, count(*) OVER w AS shard_docs
                  FROM t, (SELECT unnest(generate_series(0, 24)) AS k) g WINDOW w AS (PARTITION BY g.k, substr(bits, 1, g.k)))
            SELECT doc_id, shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
            FROM l WHERE shard_bytes <= {sharding.LIMIT} OR shard_docs = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
        "op5_line_dedup": f"""
            WITH t AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
                   regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', '', 'g'), '{line_dedup.BREAKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g') AS body FROM pages),
            p AS (SELECT page_id, host, list_filter(list_transform(string_split_regex(body, '[\\n\\r]+'), lambda x: regexp_replace(x, '^[\\x20\\t]+|[\\x20\\t]+$', '', 'g')), lambda x: x <> '') AS lines FROM t),
            e AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p),
            n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
            d AS (SELECT e.host, e.line FROM e JOIN n ON e.host = n.host GROUP BY e.host, e.line, n.pages
                  HAVING n.pages >= {line_dedup.LEAST_PAGES} AND count(*) >= {line_dedup.LEAST_REPEATS} AND count(*) / n.pages > {line_dedup.RATIO}),
            g AS (SELECT e.page_id, list(e.line) AS gone FROM e JOIN d ON e.host = d.host AND e.line = d.line GROUP BY e.page_id),
            k AS (SELECT p.page_id, p.host, p.lines, CASE WHEN g.gone IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(g.gone, x)) END AS kept FROM p LEFT JOIN g ON p.page_id = g.page_id)
            SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM k""",
        "op6_chat_formatting": """
            WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 4 = 0 THEN -turn ELSE turn END AS place FROM conversations),
            calls AS (SELECT * FROM m WHERE role = 'user' AND text IS NOT NULL), results AS (SELECT * FROM m WHERE role = 'assistant' AND text IS NOT NULL),
            firsts AS (SELECT conv_id, turn, min(place) AS place FROM calls GROUP BY conv_id, turn), answers AS (SELECT conv_id, turn - 1 AS turn, min(place) AS place FROM results GROUP BY conv_id, turn),
            pairs AS (SELECT f.conv_id, f.turn FROM firsts f JOIN answers a ON f.conv_id = a.conv_id AND f.turn = a.turn AND NOT (f.conv_id % 5 = 1 AND f.turn = 2)),
            nodes AS (SELECT conv_id, turn, 'call' AS what, place FROM firsts UNION ALL SELECT conv_id, turn, 'result', place FROM answers),
            up AS (SELECT n.*, CASE WHEN n.what = 'result' THEN o.turn ELSE e.turn END AS up_turn, CASE WHEN n.what = 'result' THEN 'call' ELSE 'result' END AS up_what
                   FROM nodes n LEFT JOIN pairs o ON n.conv_id = o.conv_id AND n.turn = o.turn LEFT JOIN pairs e ON n.conv_id = e.conv_id AND n.turn - 2 = e.turn),
            o AS (SELECT conv_id, turn, what, place, place AS order_turn, 0 AS depth FROM up WHERE up_turn IS NULL
                  UNION ALL SELECT u.conv_id, u.turn, u.what, u.place, greatest(u.place, o.order_turn), CASE WHEN o.order_turn >= u.place THEN o.depth + 1 ELSE 0 END
                  FROM up u JOIN o ON u.conv_id = o.conv_id AND u.up_turn = o.turn AND u.up_what = o.what),
            c AS (SELECT o.*, t.text, p.turn IS NOT NULL AS answered, CASE WHEN t.turn < 2 THEN length(t.text) % 2 = 1 ELSE t.turn >= 4 END AS broken,
                  CASE WHEN t.turn < 2 THEN '{"chars":' || CASE WHEN length(t.text) % 2 = 1 THEN '"' || length(t.text) || '"' ELSE CAST(length(t.text) AS VARCHAR) END || ',"lang":null}'
                  ELSE '{"mode":"' || CASE WHEN t.turn < 4 THEN 'fast' ELSE 'slow' END || '","turn":' || t.turn || '}' END AS arguments
                  FROM o JOIN calls t ON o.what = 'call' AND o.conv_id = t.conv_id AND o.turn = t.turn LEFT JOIN pairs p ON o.conv_id = p.conv_id AND o.turn = p.turn)
            SELECT conv_id, turn, turn AS order_turn, CAST(0 AS INTEGER) AS depth, 'plain' AS kind, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_problems,
                   '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message
            FROM conversations
            UNION ALL SELECT -1 - conv_id, place, order_turn, CAST(depth AS INTEGER), 'calls', 1, CAST(broken AS BIGINT), '{"role":"assistant","tool_calls":[{"arguments":' || arguments || ',"id":"' || CASE WHEN conv_id % 5 = 1 AND turn = 2 THEN 'x' ELSE 'c' END || turn || '","name":"'
                   || CASE WHEN turn < 2 THEN 'measure"' ELSE 'look"' END || CASE WHEN NOT broken THEN '' WHEN turn < 2 THEN ',"problems":["$.chars: not of type integer"]' ELSE ',"problems":["$.mode: not in enum"]' END
                   || ',"status":"' || CASE WHEN answered THEN 'answered' ELSE 'unanswered' END || '"}]}' FROM c
            UNION ALL SELECT -1 - o.conv_id, o.place, o.order_turn, CAST(o.depth AS INTEGER), 'result', 0, CASE WHEN p.turn IS NULL THEN 1 ELSE 0 END, '{"content":' || length(r.text) || ',"role":"tool","status":"'
                   || CASE WHEN p.turn IS NULL THEN 'orphan' ELSE 'linked' END || '","tool_call_id":"c' || o.turn || '"}'
            FROM o JOIN results r ON o.what = 'result' AND o.conv_id = r.conv_id AND o.turn = r.turn - 1 LEFT JOIN pairs p ON o.conv_id = p.conv_id AND o.turn = p.turn""",
        "op10_decontamination": r"""
            WITH RECURSIVE s AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word),
            i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), word) AS w FROM benchmark, s),
            d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), word) AS w FROM documents, s),
            iw AS (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
            dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT d.r, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) l)),
            h AS (SELECT dw.r, dw.n, dw.k, iw.id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
            p AS (SELECT r, count(DISTINCT at_) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS at_ FROM (SELECT DISTINCT r, n, k FROM h)) GROUP BY r),
            o AS (SELECT r, list(DISTINCT id ORDER BY id) AS ids FROM h GROUP BY r)
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, CAST(coalesce(len(o.ids), 0) AS BIGINT) AS n_items,
                   sha256(coalesce(array_to_string(o.ids, ','), '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN o ON d.r = o.r""",
    }
