"""The pipeline's stages against brute force, each on its own input; and the queries against their SQL."""

import glob
import os
import random
import re

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from gaussmill.llm import byte_bpe, queries
from tests.llm.test_near_copies import plain_roots
from tests.llm.test_operators import plain_hits, sha


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns
        kept[k] = [r.asDict() for r in frame.collect()]
        frame = spark.createDataFrame(kept[k], docs.schema) if k < len(corpus_pipeline.STAGES) - 1 else frame
    graded = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = {r["doc_id"] for r in kept[0]}
    clean = [i for i, r in graded.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in first for i in clean) >= 0.97 * len(clean)
    norm = {}
    for r in kept[0]:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
    assert {r["doc_id"] for r in kept[1]} == {min(v) for v in norm.values()}
    assert {r["doc_id"] for r in kept[2]} == set(plain_roots([(r["doc_id"], r["text"]) for r in kept[1]]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in kept[3]} == {h[0] for h in plain_hits([(r["doc_id"], r["text"]) for r in kept[2]], items) if not h[5]}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f.read()), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in kept[3]}
    for r in kept[4]:
        assert r["decoded"] == text[r["doc_id"]] and list(memoryview(bytes(r["ids"])).cast("I")) == library.encode_ordinary(text[r["doc_id"]])
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in whole) == sorted(text)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine, theirs = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    as_rows = lambda t: sorted(map(repr, t[names].astype(object).itertuples(index=False, name=None)))
    assert as_rows(mine) == as_rows(theirs)


def test_privacy_sql_on_crowded_texts(spark, tmp_path):
    """Texts full of entities, near misses and names that give entities away: operator and SQL agree on all spans."""
    draw = random.Random(5)
    people = [(f"p{k}@site{k % 7}.example.org", f"Zu\u00f1iga{chr(97 + k % 26)}{chr(97 + k // 26)}", f"+44 20 79{k:02} 1234") for k in range(40)]
    noise = ["10.0.0.1", "256.1.1.1", "001.2.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "a@b", "a@b.c.", "x@@y.z", "+1 (2)", "word", "Word", "ab", "\u6f22\u5b57\u8a9e", "x.Word", "Word_", "-Word", "Word.", "", "\n"]
    texts = []
    for k in range(400):
        mail, name, phone = draw.choice(people)
        own = [mail, name, phone.replace(" ", draw.choice([" ", "-", "."])), name.upper(), f"{name}'s", f"({name})", f"{name}.{name}"]
        texts.append("".join(draw.choice([*own, *noise]) + draw.choice([" ", "  ", ", ", "; "]) for _ in range(draw.randint(0, 25))))
    rows = [(k, t) for k, t in enumerate([*texts, None, "", "no data"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.sql(queries.oracle_sql()["op2_privacy"])
    found = queries.queries()["op2_privacy"](spark, str(tmp_path)).select(*theirs.columns).collect()
    assert sorted(map(tuple, found)) == sorted(theirs.fetchall())
    assert all(sum(r[f"n_{k}"] for r in found) > 100 for k in ("email", "ip", "card", "phone", "term"))


def test_all_ten_are_registered():
    names = list(queries.queries())
    assert [n for n in names if n != "pipeline"] == sorted((n for n in names if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 11 and sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_a_stage_begins_without_the_garbage_of_the_one_before(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    held = []
    begun = corpus_pipeline.stage(lambda spark, docs, sf_dir: held.append(full()) or docs)
    before = full()
    begun(spark, spark.range(1), "")
    assert held[0] > before
