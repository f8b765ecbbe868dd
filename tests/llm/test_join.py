"""The shingle join, signatures and vector links against brute force, with odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silovalue.functions import lineage
from silovalue.llm import common, ngram_join, spotsigs, vector_graph

DOCS = "doc_id bigint, text string, component_id string, n_shingles int"


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def least_reachable(ids, linked):
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def sample_texts():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choices(vocabulary, k=60) for _ in range(6)]
    texts = [None, "", " \t\n", "one two", "ONE\ttwo", "one two three four five", " ".join(rnd.choices(vocabulary, k=20_000))]
    for words in base:
        for _ in range(12):
            edited = list(words)
            for _ in range(rnd.randint(0, 3)):
                edited[rnd.randrange(60)] = rnd.choice(vocabulary)
            texts.append(" ".join(edited))
    group = " ".join(rnd.choices(vocabulary, k=40))
    texts += [group] * 40
    return texts


def test_join_equals_brute_force(spark):
    texts = sample_texts()
    docs = spark.createDataFrame([(i * 7, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    sets = {i * 7: shingles(t) for i, t in enumerate(texts)}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)

    classes = least_reachable(sorted(sets), linked)
    assert got == {d: (len(s), classes[d]) for d, s in sets.items()}
    kept = ngram_join.keep_one(docs, ngram_join.join(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))
    assert kept.columns == docs.columns


def groups_by_brute_force(rows):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(shingles(text))

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])

    return least_reachable(sorted(sets), linked)


def test_a_phrase_of_many_documents_hides_no_link(spark):
    rnd = random.Random(9)
    phrase = [f"p{i}" for i in range(6)]
    rows = [(i, " ".join([*phrase, *(f"d{i}x{j}" for j in range(40))])) for i in range(150)]
    a = [*phrase, "x1", "x2"]
    rows += [(500, " ".join(a)), (501, " ".join([*a, "x3"]))]
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == groups_by_brute_force(rows) and got[501] == 500


@pytest.mark.parametrize("common_from,masked,dense", [(2, 32, 16), (3, 2, 3), (5, 4, 1000), (8, 32, 2)])
def test_sizes_that_steer_the_work_leave_the_result(spark, monkeypatch, common_from, masked, dense):
    monkeypatch.setattr(ngram_join, "COMMON_FROM", common_from)
    monkeypatch.setattr(ngram_join, "MASKED_FROM", masked)
    monkeypatch.setattr(ngram_join, "DENSE_FROM", dense)
    monkeypatch.setattr(ngram_join, "TILE_BLOCK", 7)
    rnd = random.Random(common_from)
    phrases = [[f"p{x}_{i}" for i in range(rnd.randrange(5, 14))] for x in range(6)]
    rows = []
    for doc in range(130):
        base = rnd.randrange(25)
        words = [w for x in rnd.sample(range(6), rnd.randrange(1, 4)) for w in phrases[x]] + [f"b{base}_{i}" for i in range(rnd.randrange(4, 16))]
        if rnd.random() < 0.5:
            words = [*phrases[base % 6], *(f"b{base}_{i}" for i in range(12)), *(f"n{doc}_{i}" for i in range(rnd.randrange(3)))]
        rows.append((doc if doc % 17 else 3, " ".join(words)))  # some ids come again with other texts
    rows += rows[:20]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == groups_by_brute_force(rows)


def test_few_edges_over_many_partitions_leave_few_files(spark, monkeypatch):
    """Rounds of a small table ran in as many tasks as the session's width, each with its files."""
    rows = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 2) for i in range(0, 20, 2)] + [(7, 7)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    written = []
    keep = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (20_000, 9):
            monkeypatch.setattr(common, "EDGES_OF_A_TASK", most)
            written.clear()
            edges = spark.createDataFrame(rows, "a bigint, b bigint").repartition(40)
            got = {r.node: r.component for r in common.components(edges).collect()}
            assert got == {i: 0 if i <= 21 else i - i % 2 for i in range(60)}
            assert {t.rdd.getNumPartitions() for t in written[1:]} == {1 if most > 40 else 5}
            assert spark.conf.get(common.SHUFFLE_SETTING) == "false"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_ids_link_with_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (4, text), (2, text), (2, text), (2, None)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 26, None)] * 2 + [(4, 26, 2), (2, 26, 2), (2, 26, 2), (2, 0, 2)], key=str)


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n,m", [(1, 1), (40, 38), (500, 700), (3000, 2900)])
def test_bounds_are_never_below_the_overlap(n, m):
    rng = np.random.default_rng(n)
    pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
    a, b = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + m])
    exact = len(np.intersect1d(a, b))
    assert ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) >= exact
    x, y = (np.frombuffer(ngram_join.mask(s), dtype=np.uint64) for s in (a, b))
    assert (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2 >= exact


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    vectors = np.concatenate([base + 0.05 * rng.normal(size=base.shape) for _ in range(8)])
    rows = [(i, v.tolist(), 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1)]
    rows += [(904, vectors[0].tolist(), 1), (905, (vectors[0] * 2).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component_id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.near_duplicates(frame).collect()}
    sound = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in sound.items()}

    def linked(a, b):
        return a in unit and b in unit and float(unit[a] @ unit[b]) >= 0.95

    ids = sorted(i for i, _, _ in rows)
    classes = least_reachable(ids, linked)
    links = {i: sum(linked(i, j) for j in ids if j != i) for i in ids}
    assert got == {i: (links[i], classes[i], classes[i] == i) for i in ids}


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, []), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_graph.near_duplicates(frame).collect()
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert vector_graph.near_duplicates(frame.where(F.lit(False))).count() == 0


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 24))
    vectors = np.concatenate([base + 0.06 * rng.normal(size=base.shape) for _ in range(8)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[rng.permutation(len(vectors))])], "vec_id bigint, embedding array<double>")
    links, classes = vector_graph.near_links(frame, shard=150)
    found, known = vector_graph.audit_recall(frame, links, classes)
    assert known > 150 and found >= 0.9 * known


def test_signatures_of_edited_texts(spark):
    import hashlib

    texts = ["the cat of a house is in the garden " * 4, None, "", "x", "ää öö üü the of and", "the cat of a house is in the garden " * 4]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in spotsigs.edit_study(docs, spotsigs.common_words(docs)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for place, doc in enumerate(order):
        text, following = texts[doc] or "", texts[order[(place + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert rows[doc].n_chars == len(text)
        assert rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[doc].near_edited <= 1 and 0 <= rows[doc].near_next <= 1
    assert rows[0].fingerprint == rows[5].fingerprint
    none = docs.where(F.lit(False))
    assert spotsigs.edit_study(none, spotsigs.common_words(none)).count() == 0


def test_chains_and_likeness_by_hand():
    vocabulary = {w: i for i, w in enumerate("the of a cat house garden tree sun".split(), 1)}
    ids = lambda text: np.array([vocabulary[w] for w in text.split()], dtype=np.uint64)
    anchors = ids("the of a")

    def chains(text):
        words = text.split()
        bare = [w in ("the", "of", "a") for w in words]
        out = set()
        for at in [-1, *(i for i, b in enumerate(bare) if b)]:
            following = [w for w, b in zip(words[at + 1 :], bare[at + 1 :]) if not b][:2]
            if following or all(bare):
                out.add((words[at] if at >= 0 else "", *following))
        return out if words else set()

    rnd = random.Random(3)
    texts = ["", "the", "the of a", "cat", "cat the", "the cat"] + [" ".join(rnd.choices(list(vocabulary), k=rnd.randrange(1, 14))) for _ in range(200)]
    prints = [spotsigs.signatures(ids(t), anchors) for t in texts]
    for t, p in zip(texts, prints):
        assert len(p) == len(chains(t)), t
    for (s, x), (t, y) in itertools.islice(itertools.combinations(zip(texts, prints), 2), 4000):
        a, b = chains(s), chains(t)
        assert spotsigs.likeness(x, y) == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_similar_fingerprints_equal_all_pairs(spark):
    rnd = random.Random(6)
    base = [rnd.choices([f"w{i}" for i in range(60)] + ["the", "of", "a"] * 8, k=80) for _ in range(8)]
    texts = []
    for words in base:
        for _ in range(5):
            edited = list(words)
            for _ in range(rnd.randrange(4)):
                edited[rnd.randrange(80)] = rnd.choice(["the", "w3", "w9"])
            texts.append(" ".join(edited))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None, "", texts[0]])], "doc_id bigint, text string")
    anchors = spotsigs.common_words(docs, 3)
    prints = spotsigs.fingerprints(docs, anchors)
    rows = {r.doc_id: spotsigs.decoded(r.fingerprint) for r in prints.collect()}
    reps = {}
    for doc in sorted(rows):
        if len(rows[doc]):
            reps.setdefault(rows[doc].tobytes(), doc)
    want = {(a, b) for a, b in itertools.combinations(sorted(reps.values()), 2) if spotsigs.likeness(rows[a], rows[b]) >= 0.75}
    assert {(r.a, r.b) for r in spotsigs.similar(prints).collect()} == want and want
