"""Spelling variants, periodic runs and source mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import mixing, periodic, queries, spelling

# Periodic runs


def plain_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(rng, alphabet, n, share):
    w = [str(rng.randrange(alphabet)).encode() for _ in range(n)]
    if n and rng.random() < share:
        p, a = rng.randint(1, max(1, n // 2)), rng.randrange(n)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    return w


@given(st.randoms(use_true_random=False), st.integers(1, 6), st.lists(st.integers(0, 90), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_are_the_plain_ones(rng, alphabet, sizes):
    docs = [repeated(rng, alphabet, n, 0.6) for n in sizes]
    assert periodic._document_runs(docs, 12) == [plain_runs(w) for w in docs]


def test_runs_inside_runs():
    block = [b"a"] * 14 + [b"x", b"y"]
    w = (block * 3 + [b"z"]) * 4
    assert periodic._document_runs([w], 12)[0] == plain_runs(w)
    fibonacci, last = [b"a", b"b"], [b"a"]
    while len(fibonacci) < 600:
        fibonacci, last = fibonacci + last, fibonacci
    assert periodic._document_runs([fibonacci, fibonacci], 12) == [plain_runs(fibonacci)] * 2


def test_op12_on_all_documents(spark, sf):
    """Every digest, recomputed word by word."""
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    texts = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        elif n > 400:
            continue  # the plain search takes the square of a document
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_periodic_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "a " * 30, 2), (3, "a b " * 100_000, 3), (3, "a b " * 100_000, 3), (4, "x" * 300_000, 4)]
    got = periodic.detect(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    runs = [[tuple(x) for x in r["runs"]] for r in got]
    assert runs == [[], [], [(0, 30, 1)], [(0, 200_000, 2)], [(0, 200_000, 2)], []]
    assert [r["collapsed"] for r in got] == ["", "", "a", "a b", "a b", "x" * 300_000]
    assert periodic.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic.detect(spark.createDataFrame(rows, "doc_id long, text string, runs int"), least=8)


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: best[w] if best[w] and counts[best[w]] >= 5 * counts[w] else None for w in counts}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found_variants(words):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words).collect()}


@pytest.mark.parametrize("group", [512, 4])
def test_variants_are_the_plain_ones(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(group)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("abé") for _ in range(rng.choice([6, 7, 8, 13])))
        for _ in range(8):
            i, c = rng.randrange(len(base)), rng.choice("abcßÿ")
            word = rng.choice([base, base[:i] + c + base[i:], base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :]])
            counts[word] = rng.choice([5, 5, 6, 30, 31, 200, 5000])
    counts["x" * 4000], counts["x" * 4001] = 5, 50
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found_variants(words) == plain_variants(counts)


@given(st.lists(st.text("ab", min_size=4, max_size=5), min_size=2, max_size=30, unique=True))
@settings(max_examples=200, deadline=None)
def test_tiles(words):
    near, best = spelling.compare(words, 4, 1 << 30)
    for i, a in enumerate(words):
        own = [j for j, b in enumerate(words) if j != i and one_edit(a, b) and 4 in (len(a), len(b))]
        assert (near[i], best[i]) == (len(own), min(own, default=len(words)))


def test_vocabulary_is_the_plain_count(spark, sf):
    want = Counter()
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r["word"]: r["n"] for r in spelling.vocabulary(queries.table(spark, sf, "documents"), delete_every=199).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def test_spelling_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "Letters letters LETTERS letters letterz", 2), (3, "letters " * 30, 3), (3, "letters " * 30, 3), (4, "y" * 300_000, 4), (5, "letterz " * 5, 5)]
    words = spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string, word int"))
    assert {r["word"]: r["n"] for r in words.collect()} == {"letters": 64, "letterz": 6}
    assert found_variants(words) == {"letters": (None, "letters", 64, 1, None), "letterz": ("letters", "letters", 6, 1, 64)}
    assert found_variants(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))) == {}


# Mixing


def plain_targets(sizes):
    """Round by round, as it is told: share, cut at the cap, share the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def mixed(spark, rows, kind="doc_id long, text string, source string"):
    return mixing.mix(spark.createDataFrame(rows, kind)).collect()


def test_mix_of_all_documents(spark, sf):
    got = [r.asDict() for r in queries.op13_source_mixing(spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in queries.op13_source_mixing(spark, sf).repartition(7).collect())  # reruns agree
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] == (r["taken"] // r["size"] if r["size"] else 0)
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 1
        own = [r for r in got if r["source"] == source]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[source] for r in own)
        assert sum(r["size"] > 0 and r["taken"] % r["size"] > 0 for r in own) <= 1  # all but one in whole copies


def test_targets_stop_at_the_cap(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "a"), (5, "b"), (1, "c"), (400, "d"), (90, "e"), (30, None), (0, "z")])]
    got = mixed(spark, rows)
    sizes = {r["source"]: r["source_size"] for r in got}
    want = plain_targets(sizes)
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in want.items()}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_odds_favour_long_texts(spark):
    """Half of a source is taken: fragments of 4 words are chosen less often than texts of 400."""
    rows = [(i, "w " * (4 if i % 2 else 400), "a" if i < 2000 else "b") for i in range(4000)]
    got = [r for r in mixed(spark, rows) if r["source"] == "a"]
    share = lambda size: sum(r["taken"] for r in got if r["size"] == size) / sum(r["size"] for r in got if r["size"] == size)
    assert 0.6 < share(400) < 0.72 and share(4) < 0.35


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (None, "x y", None, 1), (None, "x y", None, 1), (3, "x y", "b", 1), (3, "x y", "b", 1), (3, "x y", "b", 1), (4, "w " * 50_000, "c", 1)]
    got = mixed(spark, rows, "doc_id long, text string, source string, size int")
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert len({r["taken"] for r in got if r["doc_id"] == 3}) == 1
    assert mixed(spark, []) == []
    assert [r["taken"] for r in mixed(spark, [(1, None, None), (2, "", "a")])] == [0, 0]
