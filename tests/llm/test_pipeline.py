"""The pipeline's stages against plain versions on a small corpus."""

import duckdb
import pytest
from conftest import components, shingle_set

import corpus_pipeline
from pixelloom.llm import quality, queries, toxicity


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What every stage leaves: doc_id to text."""
    docs, out = queries.table(spark, sf, "documents"), []
    out.append({r["doc_id"]: r["text"] for r in docs.collect()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append({r["doc_id"]: r["text"] for r in docs.collect()})
    out.append({r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()})
    return out


def test_classifiers_decide(spark, sf, kept):
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r["score"] >= 0.5}
    assert set(kept[1]) == set(kept[0]) - toxic
    clean = docs.join(spark.createDataFrame([(k,) for k in kept[1]], "doc_id long"), "doc_id").select(docs.columns)
    poor = {r["doc_id"] for r in quality.score(clean, quality.train(clean, labels)).collect() if r["score"] < 0.5}
    assert set(kept[2]) == set(kept[1]) - poor


def test_near_copies_go(kept):
    ids = sorted(kept[2])
    sets = [shingle_set(kept[2][i], 5) for i in ids]
    index: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        near = {j for x in s for j in index[x] if j < i}
        links |= {(i, j) for j in near if 100 * len(s & sets[j]) >= 80 * len(s | sets[j])}
    parts = components(len(ids), links)
    assert set(kept[3]) == {ids[p] for p in set(parts)}


def test_benchmark_goes(sf, kept):
    from test_texts import brute

    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    assert set(kept[4]) == set(kept[3]) - {d for d, _ in brute(list(kept[3].items()), items)}


def test_rest_is_encoded(spark, sf, kept):
    assert set(kept[5]) == set(kept[4])
    assert corpus_pipeline.run(spark, sf).count() == len(kept[5])
