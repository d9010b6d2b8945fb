"""Near-copies by similarity against brute force over all pairs of shingle sets."""

import random
from itertools import combinations

import numpy as np

from gaussmill.llm import near_copies


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(rows, similarity=0.8):
    """id -> smallest id of its component."""
    sets, parent = {i: plain_shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def corpus(seed=3):
    """Copies with more and more words changed, cut or added, beside unrelated texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t", "one two", "ONE two", "one two three"]
    for n in (6, 20, 80, 300, 2000):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for change in (0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
            texts.append(" ".join(word() if rng.random() < change else w for w in base))
        texts += [" ".join(base[: int(n * share)]) for share in (0.95, 0.85, 0.7)]
        texts.append(" ".join(base[: n // 2] + passage + base[n // 2 :]))
    texts += [" ".join([*passage, *(word() for _ in range(80))]) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_components_equal_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "id long, text string")
    want = plain_roots(rows)
    for split in (near_copies.SPLIT, 7, 3):
        found = {r.node: r.root for r in near_copies.near_components(frame.selectExpr("id", "coalesce(text, '') as text"), split=split).collect()}
        assert {i: found.get(i, i) for i, _ in rows} == want


def test_rows_that_stay(spark):
    rows = corpus()
    frame = spark.createDataFrame([(t, i, i, "x") for i, t in rows], "text string, doc_id long, id long, row string")
    kept = near_copies.drop_near_copies(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(plain_roots(rows).values())
    assert near_copies.drop_near_copies(frame.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(map(tuple, near_copies.drop_near_copies(odd).collect()), key=str) == [(5, "a b"), (None, "c")]


def test_one_node_holds_all_links():
    """A node with near-copies, doubtful pairs and strangers: sure and checked links give the components of all pairs."""
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(4)]
    sets = []
    for base in bases:
        for _ in range(60):
            held = base.copy()
            changed = rng.random(200) < rng.choice([0.01, 0.06, 0.11, 0.3])
            held[changed] = rng.integers(0, 2**63, changed.sum()).astype(np.uint64)
            sets.append(np.unique(held))
    alike = lambda i, j: (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)
    ids, sizes, bits = np.arange(240), np.array([len(s) for s in sets]), near_copies.fingerprints(sets)

    def roots(pairs):
        label = np.arange(240)
        for a, b in pairs:
            label[(label == label[a]) | (label == label[b])] = min(label[a], label[b])
        return label

    want = roots([(i, j) for i, j in combinations(range(240), 2) if alike(i, j)])
    sure, clusters = near_copies.node_links(ids, sizes, bits, 0.8)
    first, cluster = roots([(a, b) for a, b in sure if alike(a, b)]), dict(clusters)
    assert len(sure) < 240 and len(clusters) <= 240 and len(set(first.tolist())) > len(set(want.tolist()))
    assert all(cluster[i] == cluster[j] for i, j in combinations(range(240), 2) if want[i] == want[j])
    few = first != np.bincount(first).argmax()
    links = near_copies.exact_links(ids, first, few, sets, 0.8)
    assert roots([*enumerate(first.tolist()), *links]).tolist() == want.tolist() and len(links) < 240
    open_, arenas = near_copies.open_texts(ids, sizes, bits, first, few, 0.8)
    assert {x for link in links for x in link} <= set(open_.tolist()) and len(open_) == len(arenas) <= 240
    a, b = near_copies.best_partners(ids, sizes, bits, first, 0.8)
    assert len(a) <= few.sum() and (first[a] != first[b]).all()


def test_short_texts_with_one_fingerprint_are_no_copies(spark):
    """Texts of one shingle have few fingerprints; those with an equal one stay apart all the same."""
    texts = [f"short {k}" for k in range(1500)]
    bits = near_copies.fingerprints([near_copies.shingle_hashes(t) for t in texts])
    assert len(np.unique(bits, axis=0)) < len(texts)
    frame = spark.createDataFrame([*enumerate(texts), (1500, "SHORT  7")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(frame).collect()) == list(range(1500))


def test_partners_around_64_shingles_share_a_node():
    rng = np.random.default_rng(2)
    for a, b, common in ((52, 65, 52), (63, 64, 57), (63, 78, 63), (63, 64, 63)):
        for _ in range(3000):
            drawn = rng.integers(0, 2**63, a + b - common).astype(np.uint64)
            assert len(np.intersect1d(near_copies.nodes_of(drawn[:a]), near_copies.nodes_of(drawn[a - common :])))


def test_wrong_sure_links_are_undone(spark):
    """Two texts of similarity 0.778 whose estimate of 0.867 is wrong stay apart, unless another text links them."""
    words = [f"s137688w{k}" for k in range(84)]
    made = lambda changed: " ".join(w + "x" * (k in changed) for k, w in enumerate(words))
    near, far, between = made(()), made(range(74, 84)), made(range(79, 84))
    sets = [near_copies.shingle_hashes(t) for t in (near, far)]
    bits = near_copies.fingerprints(sets)
    assert near_copies.similarities(bits[0], 80, bits[1:], np.array([80]))[0][0] >= 0.8 + near_copies.SLACK
    for texts in ([near, far], [far, near, near + " end"], [near, far, between], [between, near, far]):
        rows = list(enumerate(texts))
        found = {r.node: r.root for r in near_copies.near_components(spark.createDataFrame(rows, "id long, text string")).collect()}
        assert {i: found.get(i, i) for i, _ in rows} == plain_roots(rows)
    ids, sizes = np.arange(2), np.array([80, 80])
    sure, clusters = near_copies.node_links(ids, sizes, bits, 0.8)
    assert len(sure) == 1 and len({c for _, c in clusters}) == 1
    assert not near_copies.exact_links(ids, ids, ids > 0, sets, 0.8) and len(near_copies.open_texts(ids, sizes, bits, ids * 0, ids > 0, 0.8)[0]) == 0


def test_groups_larger_than_a_part(spark):
    """Families whose cells are all in split nodes: a chain, where each text has the similarity with its neighbours alone, tight copies, and texts just too far."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for j in range(rng.choice((1, 2))):
            words[rng.randrange(120)] = f"t{k}x{j}"
        texts.append(" ".join(words))
    chain = [f"c{k}" for k in range(400)]
    texts += [" ".join(chain[6 * k : 6 * k + 100]) for k in range(40)]
    for k in range(40):
        words = list(base)
        for j in range(3):
            words[40 * j + rng.randrange(5, 35)] = f"f{k}x{j}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = {r.node: r.root for r in near_copies.near_components(spark.createDataFrame(rows, "id long, text string"), split=10).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == plain_roots(rows)
