"""Each training-data operator against a brute-force version, and on odd inputs."""

import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaussmill.llm import byte_bpe, chat, decontaminate, exact_dedup, line_dedup, privacy, quality, sharding, simhash, sstable

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "The same  text\nhere", "x"), (2, "The same text here", "x"), (3, None, None), (4, "", "y"), (5, " \t\r\n", "y"), (None, "no id", "z"), (6, LONG, "l"), (7, LONG + " end", "l"),
    (8, "é ß 漢字 🙂 İstanbul é ½ x y <|endoftext|> It's I'LL", "u"), (9, "repeated row", "r"), (9, "repeated row", "r"), (10, "a", "s"),
]
SCHEMA = "doc_id long, text string, rid string, row string, fp long, kept string, `odd name` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like working columns."""
    return spark.createDataFrame([(i, t, s, s, 1, s, s) for i, t, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# exact dedup


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(odd, docs, bits):
    for frame in (odd, docs):
        groups = {}
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        for i, t in texts(frame):
            groups.setdefault(norm(t), []).append(i)
        first = {t: min((x is None, x or 0) for x in ids) for t, ids in groups.items()}
        got = exact_dedup.duplicate_report(frame, hash_bits=bits, block_bytes=512).collect()
        by_sha = {sha(t): t for t in groups}
        assert len(got) == frame.count()
        for r in got:
            t = by_sha[r.text_sha256]
            assert r.group_size == len(groups[t]) and (r.keep_id is None, r.keep_id or 0) == first[t]
        assert sum(r.kept for r in got) == len(groups)
        kept = exact_dedup.exact_dedup(frame, hash_bits=bits, block_bytes=512)
        assert kept.columns == frame.columns and kept.count() == len(groups)


# privacy

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


def test_base_spans(spark, odd, docs):
    random.seed(5)
    made = [(100 + k, "".join(random.choice("ab@..-_%+ 0123456789()é🙂") for _ in range(200))) for k in range(150)]
    made += [(1, "a@b.c_d@e.f 1.2.3.4.5 256.1.1.1 001.2.3.4 4111 1111 1111 1111, +12 (345) 678-90123"), (2, " ".join(f"u{i}@x.com" for i in range(1500)))]
    for frame in (odd, docs, spark.createDataFrame(made, "doc_id long, text string")):
        held = {}
        for i, t in texts(frame):
            held.setdefault(i, plain_spans(t))
        for r in privacy.privacy_report(frame).collect():
            base = [s for s in r.spans.split(",") if s and not s.startswith("term")]
            assert base == held[r.doc_id] and r.base_sha256 == sha(",".join(held[r.doc_id]))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PLAIN]


def test_disclosing_terms(spark):
    rows = [(k, f"Write to ann@site.org about Quixotry today number {k}") for k in range(5)] + [(100 + k, f"Ordinary words about many things, write today {k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.privacy_report(frame).collect()}
    named = {rows[0][1][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[0].spans.split(",") if s.startswith("term")}
    # by definition: share = log2(5*65/(5*n(t))) / log2(65/5); only words seen with the address alone reach 0.8
    assert "Quixotry" in named and "today" not in named and "about" not in named
    assert got[100].spans == "" and got[100].n_term == 0
    clean = {r.doc_id: r.text for r in privacy.sanitise(frame).collect()}
    assert "ann@site.org" not in clean[0] and "Quixotry" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[100] == rows[5][1]


def test_octets_of_zero(spark):
    made = ["10.0.0.1", "127.0.0.1", "192.168.0.1", "0.0.0.0", "00.000.0000.0", "010.00.0.0255", "0.0.0.256", "0.0.0.00256", "255.255.255.255", "1.2.3.0"]
    frame = spark.createDataFrame(list(enumerate(f"at {a} now" for a in made)), "doc_id long, text string")
    for r in privacy.privacy_report(frame).collect():
        want = plain_spans(f"at {made[r.doc_id]} now")
        assert r.spans == ",".join(want) and r.n_ip == sum(s.startswith("ip") for s in want) and r.base_sha256 == sha(",".join(want))
    assert sum("[IP]" in r.text for r in privacy.sanitise(frame).collect()) == 8


def plain_terms(rows, generalise=0.8, remove=0.95, support=3):
    """Term spans by the definition, over whole texts."""
    norm = {"email": str.lower, "ip": str, "card": lambda m: re.sub("[^0-9]", "", m), "phone": lambda m: re.sub("[^0-9]", "", m)}
    spans = {i: [s.split(":") for s in plain_spans(t)] for i, t in rows}
    held = {i: {(k, norm[k](t[int(a) : int(b)])) for k, a, b in spans[i]} for i, t in rows}
    words = {i: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for i, t in rows}
    out = {i: [] for i, _ in rows}
    for i, t in rows:
        for m in re.finditer(r"(?<![\w@.%+-])[^\W\d_]{3,}(?!\.?[\w@%+-])", t):
            for e in held[i]:
                ne, nt = sum(e in h for h in held.values()), sum(m.group().lower() in w for w in words.values())
                both = sum(e in held[j] and m.group().lower() in words[j] for j in held)
                if both >= support and ne < len(rows) and np.log2(both * len(rows) / (ne * nt)) / np.log2(len(rows) / ne) >= generalise - 1e-12:
                    out[i].append(f"term:{m.start()}:{m.end()}")
                    break
    return out


def test_disclosing_terms_of_whole_documents(spark):
    far = " ".join(f"plain filler {k % 7}" for k in range(40))
    rows = [(k, f"Quixotry began. {far} Write to ann@site.org or call 10.0.0.{k % 2} today. {far} Then QUIXOTRY, Mirador ended {far} Mirador") for k in range(5)]
    rows += [(100 + k, f"Ordinary words, plain filler, write to call today then ended began {k}" + " mirador" * (k < 4)) for k in range(60)]
    got = {r.doc_id: r for r in privacy.privacy_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_terms(rows)
    for i, _ in rows:
        assert [s for s in got[i].spans.split(",") if s.startswith("term")] == want[i] and got[i].n_term == len(want[i])
    assert len(want[0]) == 2  # both Quixotry; Mirador also stands elsewhere
    clean = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "quixotry" not in clean[0].lower() and "Mirador" in clean[0]


# quality


def test_quality_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    graded = quality.grades_of(labels)
    model = quality.fit(docs, graded.where("doc_id % 4 <> 0"), 3)
    assert model.thresholds == sorted(model.thresholds)
    held = quality.score(docs, model, carry=["doc_id"]).join(graded.where("doc_id % 4 = 0"), "doc_id").collect()
    poor = [r.tail_probability for r in held if r.grade == 0]
    good = [r.tail_probability for r in held if r.grade == 2]
    assert np.mean([p < 0.5 for p in poor]) >= 0.8 and np.mean([p >= 0.5 for p in good]) >= 0.95


def test_ordinal_fit_orders_grades():
    random.seed(1)
    rows = []
    for _ in range(600):
        x = random.random()
        rows.append((int(x * 3), np.array([5, 6]), np.array([x, 1 - x])))
    model = quality.fit_rows(rows, 3, l1=0.1)
    means = [sum(model.tails({5: x, 6: 1 - x})) for x in (0.1, 0.5, 0.9)]
    assert means == sorted(means) and means[2] - means[0] > 1


def plain_features(text):
    """The documented features, counted token by token."""
    tokens, weights, distinct = text.split(), {}, {}
    if not tokens:
        return {quality._bucket("empty"): 3.0}
    total = 0.0

    def shape(token):
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token]
        return "".join(c for k, c in enumerate(kinds) if k == 0 or kinds[k - 1] != c)

    for token in tokens:
        grams = [token] if len(token) <= 64 else [token[k : k + 4] for k in range(len(token) - 3)]
        share = 1.0 if len(token) <= 64 else 0.25
        total += share * len(grams)
        for gram in grams:
            distinct[gram, share] = share
            word = gram.strip(".,;:!?*$%&#|()[]{}\"'-+/\\<>=_~^`@").lower()
            for bucket in {quality._bucket(n) for n in ("w" + word, "s" + shape(gram), *("p" + word[:k] for k in range(4, 9) if len(word) > k))}:
                weights[bucket] = weights.get(bucket, 0.0) + share
    for name, value in (("same", sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))), ("distinct", sum(distinct.values()))):
        weights[quality._bucket(name)] = weights.get(quality._bucket(name), 0.0) + value
    return {b: 3.0 * (v / total) ** 0.5 for b, v in weights.items() if v}


def test_quality_scores_equal_brute_force(spark, odd, docs):
    """Grades and tails of every row from counted features and the model's formula."""
    draw = random.Random(3)
    held = [t or "" for _, t in texts(docs)[:50]] + [t or "" for _, t in texts(odd)] + ["A-1 a-1 (word) WORD word word", "z" * 64, "z" * 65 + " b b", "..."]
    buckets = sorted({b for t in held for b in plain_features(t)})
    model = quality.OrdinalModel(3, [-0.5, 0.75], {b: draw.uniform(-1, 1) for b in buckets})
    found = quality.score(spark.createDataFrame([(k, t) for k, t in enumerate(held)], "doc_id long, text string"), model, carry=["doc_id"]).collect()
    assert len(found) == len(held)
    for r in found:
        x = sum(model.weights[b] * v for b, v in plain_features(held[r.doc_id]).items())
        tails = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(tails)) and r.tail_probability == pytest.approx(tails[1])


def test_quality_fit_reads_one_row_of_an_id(spark):
    """Rows that share a labelled id count once, whatever their order, so that the bound of labels holds."""
    words = ["fine clean text here", "poor poor poor", "other words again"]
    once = [(k, words[k % 3] + f" n{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, 0 if k % 3 == 1 else 2) for k in range(60)], "doc_id long, grade int")
    fitted = []
    for rows in (once, [*once, *[once[1]] * 500], [*[once[1]] * 500, *reversed(once)]):
        fitted.append(quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels, 3, l1=0.1))
    assert fitted[0].weights and fitted[0] == fitted[1] == fitted[2]
    assert fitted[0].tails(quality.Featurizer().features(words[0]))[1] > fitted[0].tails(quality.Featurizer().features(words[1]))[1]


def test_quality_odd(spark, odd, empty, sf):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (4, 0, None), (6, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(odd, labels).count() == len(ODD)
    assert quality.select_quality(odd, labels.limit(0)).count() == len(ODD)
    assert quality.select_quality(odd, labels).columns == odd.columns
    assert quality.quality_report(empty, labels).count() == 0


def test_quality_reads_all_of_a_long_token():
    """Text without spaces: what stands late in it, at any offset, gives features as what stands first."""
    known = quality.Featurizer()
    random.seed(4)
    plain = "".join(chr(0x4E00 + random.randrange(3000)) for _ in range(20_000))
    for at in (100, 7_003, 19_990):
        changed = known.features(plain[:at] + "毒毒語句毒" + plain[at:])
        assert quality._bucket("w毒語句毒") in changed and changed != known.features(plain)
    few = known.features("a b " + "x" * 65)
    assert few[quality._bucket("wa")] == pytest.approx(3 * (1 / (2 + 62 / 4)) ** 0.5) and few[quality._bucket("wxxxx")] == pytest.approx(3 * (15.5 / 17.5) ** 0.5)
    assert quality._bucket("w" + "x" * 64) in known.features("x" * 64)


# sharding


def test_sharding(spark, odd, docs, empty):
    hot = spark.createDataFrame([(7, "x" * 50)] * 60 + [(k, "y" * 40) for k in range(100)], "doc_id long, text string")
    for frame, limit, step in ((docs, 60_000, 3), (odd, 300, 4), (hot, 400, 12), (empty, 10, 3)):
        got = sharding.shard_assignment(frame, limit=limit, step=step).collect()
        assert len(got) == frame.count()
        sizes = {}
        for r in got:
            assert r.depth == len(r.shard)
            assert r.shard_bytes <= limit or r.shard_docs == 1
            sizes.setdefault(r.shard, []).append(r.shard_docs)
        assert all(len(v) == v[0] for v in sizes.values())
        for a in sizes:  # shards are disjoint, and a bucket was split only if it had to be
            assert not any(b != a and b.startswith(a) for b in sizes)


def test_shards_are_written(docs, spark, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), limit=60_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard_prefix").distinct().count() > 1


# line dedup


def test_line_dedup(spark, empty):
    pages = [(k, "http://A.example/x", f"Menu\nbody {k}\nMenu\n\nFooter") for k in range(5)] + [(5, "https://u:p@b.example:80/", "Menu\nonly"), (6, None, None), (7, "no url", "Menu"), (8, "http://a.example", "")]
    frame = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, text string, host string")
    got = {r["row"].page_id: r for r in line_dedup.dedup_lines(frame, F.col("url"), F.col("text"), ratio=0.5).collect()}
    assert got[0].kept == ["body 0"] and got[0].lines == ["Menu", "body 0", "Menu", "Footer"]
    assert got[5].host == "b.example" and got[5].kept == ["Menu", "only"]
    assert got[6].kept == [] and got[7].kept == ["Menu"]
    assert line_dedup.dedup_lines(empty, F.col("text"), F.col("text")).count() == 0


@pytest.mark.parametrize("bits", [64, 5])
def test_line_dedup_by_host_size(spark, bits):
    """Hosts of 1, 2, 3, 4, 10 and 40 pages at the defaults against the definition, also with keys that many lines share."""
    random.seed(9)
    pages = []
    for n in (1, 2, 3, 4, 10, 40):
        for k in range(n):
            lines = [f"own {n} {k}", "menu", "menu", "\u00e9 footer " + "x" * 3000] + [f"some {j}" for j in range(12) if random.random() < j / 12]
            random.shuffle(lines)
            pages.append((len(pages), f"https://h{n}.example/{k}", "\n".join(lines)))
    pages.append(pages[-1])
    want = {}
    for i, u, t in pages:
        own = [x[2].split("\n") for x in pages if x[1].split("/")[2] == u.split("/")[2]]
        share = {line: sum(line in p for p in own) for line in set(t.split("\n"))}
        want[i] = [line for line in t.split("\n") if len(own) < 3 or share[line] < 2 or share[line] / len(own) <= 0.3]
    frame = spark.createDataFrame([(*p, "clash", 7) for p in pages], "page_id long, url string, text string, key string, rid int")
    got = line_dedup.dedup_lines(frame, F.col("url"), F.col("text"), key_bits=bits).collect()
    assert len(got) == len(pages) and all(r.kept == want[r["row"].page_id] and r["row"].key == "clash" for r in got)
    assert all(f"own {n} {k}" in want[i] for i, (n, k) in enumerate((n, k) for n in (1, 2, 3, 4, 10, 40) for k in range(n)))


# chat


def test_chat(spark):
    call = lambda i, name, args, **more: json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args, **more}]})
    result = lambda i, c="ok": json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("b", {"z": 1, "a": 2})), (1, 2, "assistant", call("a", "f", '{"x":1}')), (1, 3, "assistant", call("b", "f", {"x": "q"}, after=["a"])),
        (1, 5, "tool", result("a")), (1, 6, "tool", result("zz")), (1, 7, "tool", result("a")), (None, None, None, None),
        (2, 0, "assistant", call("c", "g", {}, after=["d"])), (2, 1, "tool", result("c")), (2, 2, "assistant", call("d", "g", {}, after=["c"])), (2, 3, "tool", result("d")), (3, 0, "tool", "{broken"),
    ]
    schema = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect()
    assert len(out) == len(rows)
    first = sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.order_turn, r.depth, r.turn))
    assert [r.turn for r in first] == [0, 2, 5, 3, 1, 6, 7]
    held = {(r.conv_id, r.turn): json.loads(r.message) for r in out}
    assert held[1, 2]["tool_calls"][0]["status"] == "answered" and held[1, 2]["tool_calls"][0]["arguments"] == {"x": 1}
    assert held[1, 3]["tool_calls"][0]["problems"] == ["$.x: not of type integer"]
    assert held[1, 6]["status"] == "orphan" and held[1, 7]["status"] == "repeated"
    assert held[None, None] == {"content": None, "role": None}
    assert held[3, 0]["content"] == "{broken"
    for r in out:
        assert r.message == chat.canonical(json.loads(r.message))


def plain_order(turns, edges):
    """Order turn and depth by the definition, source by source; messages on or below cycles keep their turn."""
    up, out = {}, {}
    for a, b in edges:
        if a != b:
            up.setdefault(b, set()).add(a)
    while True:
        ready = [v for v in turns if v not in out and all(u in out for u in up.get(v, ()))]
        if not ready:
            return {v: out.get(v, (turns[v], 0)) for v in turns}
        for v in ready:
            last = max((out[u] for u in up.get(v, ())), default=None)
            out[v] = (turns[v], 0) if last is None or last[0] < turns[v] else (last[0], last[1] + 1)


def test_order_of_long_chains_and_cycles(spark):
    rng = random.Random(8)
    turns = {k: rng.randrange(400) for k in range(900)}
    edges = [(k, k + 1) for k in range(299)]  # one chain of 300
    edges += [(rng.randrange(300, k), k) for k in range(301, 700)] + [(rng.randrange(300, k), k) for k in range(301, 700) if k % 9 == 0]
    edges += [(700 + k, 700 + (k + 1) % 50) for k in range(50)] + [(700, 800), (800, 801), (802, 802), (803, 804), (801, 804)]
    nodes = spark.createDataFrame([*turns.items()], "rid long, turn long")
    got = {r.rid: (r.order_turn, r.depth) for r in chat.ordered(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_order(turns, edges)


def test_chat_odd_inputs(spark, empty):
    big = "9" * 400
    call = '{"tool_calls":[{"id":"%s","name":"f","arguments":%s}]}'
    rows = [
        (1, 0, "assistant", call % ("\\ud800", '{"x":"\\ud83d\\ude00 \\udc00"}')), (1, 1, "tool", '{"tool_call_id":"\\ud800","content":"\\ud800"}'), (1, 2, "assistant", call % ("n", '{"x":NaN}')),
        (1, 3, "assistant", call % ("b", '{"y":%s}' % big)), (1, 4, "assistant", call % ("i", '{"y":1e999}')), (1, 5, "tool", '{"tool_call_id":"b","content":' + "[" * 5000 + "]" * 5000 + "}"),
        (1, 6, "assistant", '{"tool_calls":[{"id":"w","name":"f","arguments":"[NaN","after":"b"}]}'), (1, 7, "assistant", call % ("b", "{}")), (1, 7, "assistant", call % ("b", "{}")), (1, None, "tool", '{"tool_call_id":"w"}'),
        (2, 0, "user", "long " * 200_000), (2, 0, "user", "long " * 200_000),
    ]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, kind string, rid int")
    schema = {"f": {"type": ["object", "null"], "properties": {"x": {"type": ["string", "null"]}, "y": {"type": "integer"}}, "additionalProperties": {"type": "null"}}}
    out = chat.format_messages(frame, schema).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out if (r.conv_id, r.turn) not in ((1, 7), (2, 0))}
    first = json.loads(by[1, 0].message)["tool_calls"][0]
    assert first == {"arguments": {"x": "\U0001f600 \ufffd"}, "id": "\ufffd", "name": "f", "status": "answered"} and json.loads(by[1, 1].message)["status"] == "linked"
    assert by[1, 2].kind == by[1, 4].kind == by[1, 5].kind == "plain" and by[1, 3].n_problems == 0 and big in by[1, 3].message
    assert json.loads(by[1, 6].message)["tool_calls"][0]["arguments"] == "[NaN" and by[1, 6].n_problems == 1 and by[1, None].n_problems == 0
    assert [r.n_problems for r in out if (r.conv_id, r.turn) == (1, 7)] == [1, 1] and sum(len(r.message) > 1_000_000 for r in out) == 2
    assert chat.format_messages(frame.where("false")).count() == 0
    assert chat.problems(1, True) == [] and chat.problems(1, False) == ["$: not allowed"] and chat.problems(True, {"enum": [1]}) == ["$: not in enum"]


def test_schema_checks():
    s = {"type": "object", "properties": {"n": {"type": "array", "items": {"type": "number"}}, "e": {"enum": ["a"]}}, "additionalProperties": False}
    assert chat.problems({"n": [1, 2.5], "e": "a"}, s) == []
    assert chat.problems({"n": [True], "e": "b", "q": 1}, s) == ["$.e: not in enum", "$.n[0]: not of type number", "$.q: unknown"]


# SimHash


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for k in range(len(ids)):
        if ids[k] is not None:
            low[find(k)] = min(low.get(find(k), ids[k]), ids[k])
    return [low.get(find(k)) for k in range(len(ids))]


def test_simhash_report(odd, docs, empty):
    for frame in (odd, docs):
        got = simhash.near_duplicate_report(frame).collect()
        want = {}
        for i, t in texts(frame):
            want.setdefault(i, plain_fingerprint(t))
        fps = [int(r.fingerprint, 16) for r in got]
        assert all(f == want[r.doc_id] and len(r.fingerprint) == 16 for f, r in zip(fps, got, strict=True))
        expected = plain_components([r.doc_id for r in got], fps, 2)
        assert [r.component_id for r in got] == expected
        kept = simhash.near_dedup(frame)
        assert kept.columns == frame.columns and kept.count() == len({(c, None if c is not None else r.fingerprint) for c, r in zip(expected, got, strict=True)})
    assert simhash.near_duplicate_report(empty).count() == simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("split", [4096, 3])
def test_links_with_crowded_nodes(spark, radius, split):
    random.seed(radius)
    values = {random.getrandbits(64) for _ in range(60)}
    base = random.getrandbits(64)
    for _ in range(150):  # crowded: all share 48 bits
        values.add(base ^ (random.getrandbits(16) & random.getrandbits(16) & random.getrandbits(16)))
    values = sorted(values)
    frame = spark.createDataFrame([(k, simhash._signed(v)) for k, v in enumerate(values)], "id long, fp long")
    from unittest import mock

    with mock.patch.object(simhash, "near_links", lambda nodes, r: near(nodes, r, split)) if (near := simhash.near_links) else None:
        got = {r.fp: r.component_id for r in simhash.components(frame, radius).collect()}
    want = plain_components(list(range(len(values))), values, radius)
    assert [got[simhash._signed(v)] for v in values] == want


def test_gray_index_search():
    rng = np.random.RandomState(3)
    values = np.unique(rng.randint(0, 1 << 12, 400).astype(np.uint64))
    index = simhash.GrayIndex(values)
    q, v = index.search(values, 2)
    want = {(a, b) for a in values.tolist() for b in values.tolist() if (a ^ b).bit_count() <= 2}
    assert {(int(values[a]), int(index.values[b])) for a, b in zip(q, v, strict=True)} == want
    assert (np.diff(simhash.gray_rank(index.values).astype(np.int64)) > 0).all()


# byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library(bpe):
    _, ranks, library = bpe
    encoder, decoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), byte_bpe.Decoder(ranks)
    encoder.transducer.most_states, encoder.transducer.hold = 500, 40
    random.seed(2)
    for _ in range(3000):
        letters = random.choice(["abcdefgh", "etaoin shrdlu", "é ñüß漢字🙂 ab", "0123456789 -", "aA \n\t!?", "x"])
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 150)))
        packed = encoder.encode(text)
        assert list(memoryview(packed).cast("I")) == library.encode_ordinary(text)
        assert "".join(decoder.stream(packed, step=1)) == text


def test_utf8_machine():
    data = "aé漢🙂".encode() + b"\xff\xe2\x82"
    machine = byte_bpe.Utf8Machine()
    assert "".join(machine.push(data[i : i + 1]) for i in range(len(data))) + machine.finish() == data.decode("utf-8", "replace")


def test_round_trip(odd, empty, bpe):
    path, _, library = bpe
    got = byte_bpe.round_trip_report(odd, path, public_tokenizers.PATTERN).collect()
    want = {}
    for i, t in texts(odd):
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t or ""))
    assert len(got) == len(ODD) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
    assert byte_bpe.round_trip_report(empty, path, public_tokenizers.PATTERN).count() == 0


# token shards


def test_shards(spark, odd, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame in (odd.where("doc_id is null or doc_id <> 9"), docs):
        rows = sorted(texts(frame), key=lambda r: (r[0] is not None, r[0] or 0))
        folder = sstable.write_shards(frame, path, shard_bytes=20_000)
        got = {r.doc_id: r for r in sstable.read_shards(spark, folder).collect()}
        start = 0
        for i, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            packed = struct.pack(f"<{len(ids)}I", *ids)
            assert (got[i].start, bytes(got[i].ids)) == (start, packed)
            start += len(ids)
        wanted = [rows[0][0], rows[-1][0], 10**9]
        assert {r.doc_id: bytes(r.ids) for r in sstable.lookup(spark, folder, wanted).collect()} == {i: bytes(got[i].ids) for i in wanted[:2]}
    report = sstable.shard_report(docs, path).orderBy("doc_id").first()
    assert report.ids_crc32 == zlib.crc32(bytes(got[report.doc_id].ids)) and report.n_tokens == len(got[report.doc_id].ids) // 4
    assert sstable.shard_report(odd, path).count() == len(ODD)
    assert sstable.shard_report(empty, path).count() == 0


def test_shard_format_detects_damage():
    writer = sstable.ShardWriter(0, 2, block_bytes=100)
    for k in range(200):
        assert writer.add(sstable.key_of(k), bytes([k % 250, 0]) * 3) is None
    data = writer.finish()
    reader = sstable.ShardReader(data + b"\n")
    assert [sstable.id_of(k) for k, _ in reader] == list(range(200)) and len(reader.blocks) > 5
    assert reader.lookup(sstable.key_of(77)) == [bytes([77, 0]) * 3] and reader.lookup(sstable.key_of(1000)) == []
    with pytest.raises(ValueError):
        list(sstable.ShardReader(data[:5] + bytes([data[5] ^ 1]) + data[6:]))


# decontamination


def plain_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                if found := held.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark, odd, docs, empty, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    long = " ".join(LONG.split()[100:130]).upper()
    more = [*items, (500, "a"), (501, "repeated ROW"), (502, None), (503, "!!"), (504, long), (500, "no id"), (None, "é ß 漢字"), (505, "w1 " * 14)]
    for frame, held in ((docs, items), (odd, more), (docs, more), (odd, [])):
        table = spark.createDataFrame(held, "item_id long, text string")
        got = decontaminate.contamination_report(frame, table).collect()
        assert sorted(map(tuple, got), key=repr) == plain_hits(texts(frame), held)
        kept = decontaminate.decontaminate(frame, table)
        assert kept.columns == frame.columns and kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate.contamination_report(empty, benchmark).count() == 0
