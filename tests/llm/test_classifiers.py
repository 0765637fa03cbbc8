"""Language, toxicity, quality: held-out accuracy, plain versions and odd rows."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.llm import langid, logistic, quality, queries, toxicity
from pixelloom.llm import text as T

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34 !!", "en", None, 5), (None, "the and of", None, "s", 9), (4, "the and of " * 40_000, "en", "s", 1), (5, "same", "en", "s", 4), (5, "same", "en", "s", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOC)


def truth(sf, column):
    return dict(duckdb.sql(f"select doc_id, {column} from '{sf}/{'documents' if column == 'lang' else 'labels'}.parquet'").fetchall())


def test_language_on_held_out_documents(spark, sf):
    rows = queries.op2_language_id(spark, sf).collect()
    lang = truth(sf, "lang")
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off(spark):
    said = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden of thing", "en"), ("das haus und der garten schnell", "de")] * 5)]
    model = langid.train(spark.createDataFrame(said, "doc_id long, text string, lang string"))
    guess = model.predictor()
    assert guess("garden house")[0] == "en" and guess("und der")[0] == "de"
    assert guess("schnellhaus")[0] == "de" and guess("thinging")[0] == "en"  # never seen
    assert guess(None) == guess("12 !") == guess("½ ² Ⅷ _") == ("und", 0.0)  # numerals are no letters
    assert langid.words("Cafe\u0301 Über x_1é") == ["cafe\u0301", "über", "x", "é"]


def test_language_scores_by_a_plain_scorer(spark):
    """Every word by hand: its own log frequencies, or those of the longest known n-grams from the left."""
    said = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden of thing", "en"), ("das haus und der garten schnell schön", "de")] * 5)]
    model = langid.train(spark.createDataFrame(said, "doc_id long, text string, lang string"))
    counts = {"en": Counter(said[0][1].split() * 5), "de": Counter(said[1][1].split() * 5)}
    vocabulary = sorted({w for c in counts.values() for w in c})
    grams = {lang: [Counter(f"^{w}$"[i : i + n] for w in c.elements() for i in range(len(w) + 3 - n)) for n in range(langid.NGRAM + 1)] for lang, c in counts.items()}

    def logs(table, keys, key, share):
        return {lang: np.log(share * (table[lang][key] + 0.5) / (sum(table[lang].values()) + 0.5 * len(keys))) for lang in counts}

    def plain(text):
        total = dict.fromkeys(counts, 0.0)
        for word in langid.words(text):
            parts = []
            if word in vocabulary:
                parts.append(logs(counts, vocabulary, word, 1 - langid.UNSEEN))
            else:
                marked, at = f"^{word}$", 0
                while at < len(marked):
                    for n in range(min(langid.NGRAM, len(marked) - at), 0, -1):
                        known = {g for lang in counts for g in grams[lang][n] if n == 1 or sum(grams[o][n][g] for o in counts) >= langid.RARE}
                        if marked[at : at + n] in known:
                            held = {lang: Counter({g: grams[lang][n][g] for g in known}) for lang in counts}
                            parts.append(logs(held, known, marked[at : at + n], langid.UNSEEN))
                            at += max(1, n - 1)
                            break
                    else:
                        at += 1
            for part in parts:
                for lang in counts:
                    total[lang] += part[lang]
        best = max(sorted(counts), key=lambda x: total[x])
        return best, 1 / sum(np.exp(v - total[best]) for v in total.values())

    guess = model.predictor()
    for text in ("the house", "garden schnell", "thingy housing", "schnelles gartenhaus zzz", "Q", "schönheit and ünd"):
        assert guess(text)[0] == plain(text)[0] and guess(text)[1] == pytest.approx(plain(text)[1]), text


def test_a_rare_language_is_learned(spark):
    """The bounded sample takes of every language what there is, or an equal share; a repeated row counts once."""
    rows = [(i, f"word{i} the", "en") for i in range(400)] + [(1000 + i, f"ord{i} och", "sv") for i in range(4)] + [(7, "word7 the", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, limit=40)
    assert model.languages == ["en", "sv"] and model.predictor()("och")[0] == "sv"
    ids = logistic.stratified_ids(docs, "lang", 40).collect()
    assert len(ids) == 40 and sum(r["lang"] == "sv" for r in ids) == 4


def test_clashing_columns_of_classifiers(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "s", 9, "a", 0.5, 1)], DOC + ", lang_pred string, score double, y int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert langid.predict(docs, langid.train(docs)).columns == ["doc_id", "lang_pred", "score"]
    assert quality.score(docs, quality.train(docs, labels)).columns == ["doc_id", "score"]
    assert quality.reject_poor(docs, quality.train(docs, labels), 0.0).collect() == docs.collect()
    assert toxicity.reject_toxic(docs, toxicity.train(docs, labels)).collect() == docs.collect()


def test_language_of_odd_rows(spark, docs, sf):
    model = langid.train(queries.table(spark, sf, "documents"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en" and got[None] == "en"
    assert langid.predict(docs.where("false"), model).count() == 0
    empty = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark, sf):
    toxic = truth(sf, "toxic")
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert len(rows) > 50
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in rows) >= 0.93 * len(rows)


def slice_of(text):
    ((_, _, offsets, raw),) = T.slices(pa.array([text]))
    return T.words(offsets, raw, T.ALNUM, fold_latin=True, apostrophes=True), raw


def arcs(text, learned=()):
    w, raw = slice_of(text)
    return {n: int(c) for n, c in zip(toxicity.ARCS, toxicity.Grammar(list(learned)).arcs(w, raw, 1)[0], strict=True) if c}


def prior(text):
    """The score before any label is seen."""
    return logistic.predict(toxicity.batch_features(toxicity.Grammar(), pa.array([text], pa.string())), toxicity.PRIOR)[0]


def test_grammar():
    assert arcs("What an idiot.") == {"insult": 1}
    assert arcs("You are a stupid clown!") == {"insult": 2, "aimed": 2}
    assert arcs("What an idiot you are") == {"insult": 1, "aimed": 1}
    assert arcs("You are not an idiot.") == {"insult": 1, "aimed": 1, "negated": 1}
    assert arcs("You aren't an idiot.")["negated"] == arcs("you aren\u2019t an idiot")["negated"] == 1
    assert arcs("She said you are an idiot. Idiot!") == {"insult": 2, "aimed": 1, "reported": 1}
    assert arcs('"You are an idiot," he said') == {"insult": 1, "aimed": 1, "reported": 1}
    assert arcs("I will kill you") == arcs("I'll kill you") == {"threat": 1, "to someone": 1}
    assert arcs("They kill time; I will go") == {"violence": 1}
    assert arcs("I don't want to hurt you") == {"violence": 1, "negated": 1}
    assert arcs("a zork here", ["zork"]) == {"insult": 1}
    assert arcs("plain words, nothing else") == {}


def test_weights_of_the_grammar_alone():
    """Matched clauses decide, not isolated words."""
    for bad in ("You are an idiot", "you stupid clown", "I'll kill you", "We will hurt them"):
        assert prior(bad) >= 0.5, bad
    for fine in ("an idiot", "You aren't an idiot", "She said you are an idiot", '"You are an idiot," he said', "I don't want to hurt you", "kill the process", "", None):
        assert prior(fine) < 0.5, fine


@given(st.lists(st.sampled_from([*(w for words in toxicity.LEXICON.values() for w in words.split()[:3]), "plain", "word", "a", "."]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_composed_machine_is_the_cascade(words):
    """A plain scanner that runs the five transducers one after the other over every clause."""
    code = {w: name for name in reversed(toxicity.LEXICON) for w in toxicity.LEXICON[name].split()}
    want: dict = {}
    for clause in " ".join(words).split("."):
        symbols, before = [], None
        for p, word in enumerate(clause.split()):
            if word in code:
                if before is not None and p - before > toxicity.NEAR:
                    symbols.append("gap")
                symbols.append(code[word])
                before = p
        if not {"insult", "threat"} & set(symbols):
            continue
        for machine in toxicity.cascade():
            state, written = machine.start, []
            for x in symbols:
                state, x, weight = machine.step(state, x)
                written.append(x)
                if weight:
                    want[weight] = want.get(weight, 0) + 1
            symbols = written
    assert arcs(" ".join(words)) == want


def test_toxicity_of_odd_rows(spark, docs, sf):
    model = toxicity.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    scores = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert len(scores) == len(ODD) and all(0 < s < 0.5 for s in scores)
    assert toxicity.reject_toxic(docs, model).exceptAll(docs).count() == 0
    mine = spark.createDataFrame([(1, "you are a worthless idiot", "kept"), (2, "fine words", "kept")], "doc_id long, text string, score string")
    assert [tuple(r) for r in toxicity.reject_toxic(mine, model).collect()] == [(2, "fine words", "kept")]
    untaught = toxicity.train(docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, untaught).count() == len(ODD)


def test_quality_on_labelled_documents(spark, sf):
    """Fitted on documents with an even id, held against those with an odd one."""
    label = truth(sf, "quality")
    table, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model = quality.train(table, labels.where(F.col("doc_id") % 2 == 0))
    rows = [r for r in quality.score(table, model).collect() if r["doc_id"] % 2 and label.get(r["doc_id"]) is not None]
    right = sum((r["score"] >= 0.5) == (label[r["doc_id"]] == 1) for r in rows)
    assert right >= 0.95 * len(rows)
    assert set(quality.reject_poor(table, model).columns) == set(table.columns)


def test_quality_of_odd_rows(spark, docs, sf):
    model = quality.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    scores = [r["score"] for r in quality.score(docs, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_exchange_by_a_plain_count(spark, sf):
    """All unlabelled documents are told to the other view: counted here one document, feature and bin after the other."""
    table, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels").where("quality is not null")
    model = quality.train(table, labels)
    views, bounds = [model.content, model.metadata], [(-1.0, 2.0), (-np.inf, 1.0)]
    pool = quality._binned(table, labels, views)
    rows = pool.collect()
    assert len(rows) == table.join(labels, "doc_id", "left_anti").count()
    plain = [Counter(), Counter()]
    for row in rows:
        for v, view in enumerate(views):
            odds = view.log_odds(np.array([row[v]]))[0]
            if odds >= bounds[v][1] or odds <= bounds[v][0]:
                plain[1 - v].update((j, b, int(odds >= bounds[v][1])) for j, b in enumerate(row[1 - v]))
    for view, told, counted in zip(views, quality.exchange(pool.repartition(5), views, bounds), plain, strict=True):
        starts = np.concatenate([[0], np.cumsum(view.widths)])
        got = {(j, b, label): told[starts[j] + b, label] for j, width in enumerate(view.widths) for b in range(width) for label in (0, 1)}
        assert {k: n for k, n in got.items() if n} == dict(counted) and counted


def test_quality_view_by_indicators(spark, sf):
    """The lookup of log-odds equals the product with the indicators that the weights were fitted on."""
    model = quality.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    rng = np.random.default_rng(3)
    for view in (model.content, model.metadata):
        bins = np.column_stack([rng.integers(0, w, 200) for w in view.widths])
        slow = view.encode(bins) @ view.weights[:-1] + view.weights[-1]
        assert np.allclose(view.raw(bins), np.clip(slow, -quality.LIMIT, quality.LIMIT))


def test_quality_learns_from_the_unlabelled(spark):
    """Digits say nothing about the labelled documents but all about the others; there the source tells which are poor."""

    def row(i):
        poor, shown = i % 2 == 1, i < 120
        text = ("BUY !!! NOW | " if poor else "A calm report of the day. ") * 5 if shown else "and so they went home again "
        return i, text + "7 8 9 10 " * (5 * (i // 2 % 2 if shown else poor)), "en", "farm" if poor else "press", 90

    docs = spark.createDataFrame([row(i) for i in range(4000)], DOC)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    alone, taught = (quality.train(docs, labels, confident=c) for c in ((), (0.9, 0.8)))
    unseen = docs.where("doc_id >= 120").withColumn("source", F.lit("other"))
    right = [sum((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in quality.score(unseen, m).collect()) for m in (alone, taught)]
    assert right[1] > right[0] and right[1] >= 0.95 * unseen.count()
    again = quality.train(docs.repartition(13), labels, confident=(0.9, 0.8))
    assert np.array_equal(again.content.weights, taught.content.weights) and np.array_equal(again.mix, taught.mix)


def test_fit_from_a_prior_far_off():
    x = np.repeat([[0.0], [1.0]], 50, axis=0)
    y = np.concatenate([np.arange(50) % 5 == 0, np.arange(50) % 5 > 0]).astype(float)
    near, far = logistic.fit(x, y, l2=1e-3), logistic.fit(x, y, np.array([60.0, -40.0]), l2=1e-3)
    assert np.allclose(near, far, atol=0.2) and abs(logistic.predict(np.array([[1.0]]), far)[0] - 0.8) < 0.02


@pytest.mark.parametrize("text", ["You are an “idiot”.", "You are an idiot…", "You—idiot", "ты «дурак»", "дурак。", "ДУРАК", "笨蛋", "YOU ARE AN ÍDIOT, an idiot"])
def test_signs_and_letters_of_other_scripts(text):
    grammar = toxicity.Grammar(["дурак", "笨蛋"])
    assert toxicity.batch_features(grammar, pa.array([text]))[0, 0] > 0


def test_typographic_quotations_are_reported_speech():
    plain, curly = (toxicity.batch_features(toxicity.Grammar(), pa.array([t])).tolist() for t in ('"You are an idiot", he said', "“You are an idiot”, he said"))
    assert plain == curly and plain[0][toxicity.ARCS.index("reported")] > 0


def test_short_words_are_learned(spark):
    docs = [(i, "笨蛋 傻瓜 day" if i % 2 else "a fine day") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert model.learned == ["傻瓜", "笨蛋"]


def test_many_languages_do_not_make_a_large_memo():
    """500 languages: a predictor stays within some megabytes, and texts longer than its memo are scored whole."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    many = langid.Model({f"l{i:03}": {f"word{name(i)}": 5, "all": 1} for i in range(500)}).predictor()
    assert many.entries * 8 * 500 <= langid.MEMO_BYTES
    text = " ".join(f"zz{name(i)}" for i in range(3 * many.entries)) + f" word{name(123)}" * 40_000
    got = many(text)
    assert got[0] == "l123" and many.table.nbytes <= 4 * langid.MEMO_BYTES
