import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import components, shingle_set
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.llm import decontam, jaccard_join
from pixelloom.llm import text as T


def brute(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], components(len(sets), links)


def run(spark, rows, schema="doc_id long, text string", **options):
    return jaccard_join.join(spark.createDataFrame(rows, schema), **options)


def check(spark, texts, k, percent):
    sizes, parts = brute(texts, k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, list(enumerate(texts)), k=k, percent=percent).collect()}
    assert got == {i: (n, p) for i, (n, p) in enumerate(zip(sizes, parts, strict=True))}


def corpus(seed):
    """Near copies at all distances, exact copies, a shared passage, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    base = [rng.choices(words, k=rng.choice([3, 8, 12, 40, 150])) for _ in range(12)]
    out = []
    for b in base:
        for _ in range(6):
            copy = list(b)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(passage + rng.choices(words, k=rng.choice([2, 10, 60]))) for _ in range(25)]
    out += ["", "   ", "one", "one", "One  TWO", "one two"] + [" ".join(base[4])] * 5
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 80, 3)])
def test_against_brute_force(spark, k, percent, seed):
    check(spark, corpus(seed), k, percent)


def test_many_parts_of_one_group(spark, monkeypatch):
    """A family of copies, split into many parts, with frequent tokens throughout."""
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 300)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(copy))
    check(spark, texts, 3, 90)


def test_ids_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 1)
    check(spark, corpus(9), 3, 90)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d", 7), (1, "a b c d", 8), (2, "A b c D", None), (None, "a b c d", 1), (3, None, 1), (4, None, 1)]
    got = run(spark, rows, "doc_id long, text string, component_id int", k=3, percent=90)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (None, 2, None)]
    assert run(spark, []).count() == 0


def check_counts(spark, rows, k, percent):
    """Rows of (doc_id, text): every row is a node of its own."""
    sets = [shingle_set(t, k) for _, t in rows]
    linked = lambda i, j: None not in (rows[i][0], rows[j][0]) and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    parts = components(len(rows), links)
    want = []
    for i, (d, _) in enumerate(rows):
        equal = [e for (e, _), s in zip(rows, sets, strict=True) if e is not None and s == sets[i]] if d is not None and sets[i] else [d]
        family = [e for (e, _), p in zip(rows, parts, strict=True) if p == parts[i]] if d is not None else [d]
        want.append((d, len(sets[i]), min(equal) if None not in equal else None, sum(i in x for x in links), min(family) if None not in family else None))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, count=True)
    assert got.columns == ["doc_id", "n_shingles", "class_id", "n_links", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [2, 3])
def test_every_link_is_counted(spark, monkeypatch, seed):
    """Families in one part and in many, exact copies, repeated rows, a doc_id with several texts, nulls."""
    if seed == 3:
        monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 300)
        monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    texts = corpus(seed)
    rows = list(enumerate(texts)) + [(0, texts[0]), (3, texts[9]), (500, texts[9]), (500, texts[20]), (500, None), (None, texts[4]), (2, texts[30] + " more")]
    check_counts(spark, rows, 3, 80)


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", None), (3, "q w e r t y", "z"), (4, None, None), (None, "a b c d e f", "n")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n string"))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_a_doc_id_with_several_texts(spark):
    """The link of one text is not lost because another text of the same doc_id is a copy."""
    x, y, near_y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60)), " ".join([*(f"y{i}" for i in range(59)), "z"])
    docs = spark.createDataFrame([(1, x), (5, x), (5, y), (9, near_y)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"], r["component_id"]) for r in jaccard_join.join(docs, k=3, percent=90).collect()) == [(1, 1, 1), (5, 1, 1), (5, 5, 5), (9, 9, 5)]
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs, 3, 90).collect()) == [(1, x), (5, y)]


def test_ids_of_other_types(spark):
    rows = [("b", "a b c d"), ("a", "a b c d"), ("c", "q r s t")]
    got = run(spark, rows, "doc_id string, text string", k=3, percent=90)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
    dates = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.ascii("doc_id").cast("decimal(10,0)"))
    assert sorted(int(r["component_id"]) for r in jaccard_join.join(dates, 3, 90).collect()) == [97, 97, 99]


def family(n, words=120):
    """n different near copies of one text."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        copy = [f"w{j}" for j in range(words)]
        copy[rng.randrange(words)] = f"x{i}"
        out.append(" ".join(copy))
    return out


def test_a_large_family_in_many_parts_costs_in_proportion(spark, monkeypatch):
    """Pairs of parts that are compared: one for each part, not one for each pair of parts; strays are found all the same."""
    compared = []
    whole = jaccard_join._compare

    def counting(named, nodes, packed, pairs, *rest):
        compared.append((packed.count(), pairs.count()))
        return whole(named, nodes, packed, pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_compare", counting)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 4800)
    texts = family(2000)
    got = run(spark, list(enumerate(texts)), k=5, percent=80)
    assert {r["component_id"] for r in got.collect()} == {0}
    (parts, near), (_, far) = compared
    assert 45 <= parts <= 60 and near < parts and far <= 2 * parts


def test_documents_with_enough_tokens_of_their_own_are_not_compared(spark, monkeypatch):
    """Passages that two documents share by chance make no pairs of parts; a near copy among them is found all the same."""
    compared = []
    whole = jaccard_join._compare

    def counting(named, nodes, packed, pairs, *rest):
        compared.append((packed.count(), pairs.count()))
        return whole(named, nodes, packed, pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_compare", counting)
    rng = random.Random(7)
    texts = []
    for i in range(200):
        passages = [f"p{rng.randrange(300)}" for _ in range(20)]
        texts.append(" ".join([*(f"{p}a {p}b {p}c" for p in passages), *(f"d{i}w{j}" for j in range(80))]))
    texts.append(texts[0].replace("d0w40", "other"))
    got = run(spark, list(enumerate(texts)), k=3, percent=90)
    assert {r["doc_id"] for r in got.collect() if r["doc_id"] != r["component_id"]} == {200}
    assert all(parts <= 2 and pairs <= 1 for parts, pairs in compared)


@pytest.mark.parametrize("bits", [64, 1024])
def test_tokens_that_share_a_bit_lose_no_link(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard_join, "SHARED_BITS", bits)
    check(spark, corpus(6), 3, 90)


def test_incidence_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MATRIX_COLUMNS", 7)
    monkeypatch.setattr(jaccard_join, "GROUP_DOCUMENTS", 5)
    monkeypatch.setattr(jaccard_join, "FAMILY", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 100)
    check(spark, corpus(4), 3, 80)


@given(st.lists(st.integers(1, 3000), min_size=1, max_size=6), st.lists(st.integers(1, 3000), min_size=1, max_size=6), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_bounds_are_never_below_the_overlap(left, right, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**64, 4000, np.uint64)
    a, b = ([np.unique(rng.choice(pool, n)) for n in sizes] for sizes in (left, right))
    a[0] = np.unique(a[0] >> np.uint64(int(rng.integers(0, 2)) * 40))  # one range may hold all
    docs = [jaccard_join._Documents(pa.array([[{"node": 0, "n": len(u), "counts": jaccard_join.range_counts(u).tobytes(), "component": 0} for u in side]])) for side in (a, b)]
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    got = jaccard_join._bounds(*docs, i, j).reshape(len(a), len(b))
    assert (got >= np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])).all()


@given(st.lists(st.text(alphabet="ab \t\nABé", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_hashed_shingles_are_the_sets(texts):
    assert [len(u) for u in jaccard_join._sets(pa.array(texts, pa.string()), 3)] == [len(shingle_set(t, 3)) for t in texts]


def test_a_text_longer_than_a_slice():
    long = " ".join(f"w{i}" for i in range(100_000))
    assert len(long) > 2 * T.SLICE_BYTES
    sizes = [len(u) for u in jaccard_join._sets(pa.array(["a b", long, "c d e f"]), 3)]
    assert sizes == [1, 99_998, 2]


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [16, 24, 32, 512, 1024, 4096])
def test_long_words_of_one_build_differ(spark, n):
    """Such words have one hash under every polynomial modulo 2**64."""
    a, b = thue_morse(n), thue_morse(n, "ba")
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, 3, 90).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()} == {1, 2}
    found = decontam.find_items(docs, docs.where("doc_id = 1").withColumnRenamed("doc_id", "item_id"))
    assert {r["doc_id"] for r in found.collect()} == {1, 3}


@given(st.lists(st.text("ab", min_size=20, max_size=200), min_size=2, max_size=20, unique=True))
def test_words_of_two_letters_have_hashes_of_their_own(words):
    assert len({T.hash_word(w) for w in words}) == len(words)
