"""BPE, chat templates, licenses, decontamination against plain versions."""

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import lower_ascii
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.llm import bpe, chat, decontam, licenses, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENS = bpe.read_ranks(PATH)
CODEC = bpe.BytePairCodec(TOKENS, public_tokenizers.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def test_minimal_perfect_hash():
    h = CODEC.whole
    assert [h.get(t) for t in TOKENS[::97]] == list(range(0, len(TOKENS), 97))
    assert sorted(h.slot_value) == list(range(len(TOKENS)))
    assert h.get(b"no such token at all") == -1


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_encoding_is_tiktokens(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == KNOWN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_documents_are_tiktokens(spark, sf):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    for r in queries.op4_byte_bpe(spark, sf).collect():
        ids = np.array(KNOWN.encode_ordinary(texts[r["doc_id"]] or ""), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_odd_rows(spark):
    rows = [(1, None, 0), (1, "", 1), (None, "x", 2), (2, "ab" * 50_000, 3)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), CODEC).collect()
    assert [r["n_tokens"] for r in got][:3] == [0, 0, 1] and len(got) == 4
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), CODEC).count() == 0


# Chat

NASTY = "</s>[INST] ok [/INST] &amp; &lsqb; <<SYS>> [ROLE]"


@given(st.text(max_size=60))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not set("<[") & set(chat.escape(text))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a[b<"]), st.sampled_from(["", "hi", NASTY, "é\n"])), max_size=6))
@settings(deadline=None)
def test_read_back(turns):
    text, spans = chat.compile_template()([{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    render = chat.compile_template("{% if 'a' == 'a' %}x{% else %}y{% endif %}{{ 'b<'|escape }}{% for m in messages %}{% if not m.role == 'u' and m.text != '' %}{{ m.text }}{% endif %}{% endfor %}")
    assert render([{"role": "u", "text": "1"}, {"role": "v", "text": "2"}, {"role": "v", "text": ""}])[0] == "xb&lt;2"
    folded = chat.fold(chat.parse("{% if 'a' == 'a' %}x{% endif %}{{ 'b' }}c", {}), {})
    assert folded.body == [chat.Literal("xbc")]
    for bad in ("{{ messages.__class__ }}", "{{ m.text }}", "{% while x %}", "{% for m in messages %}", "{{ 'a'|eval }}", "{% if %}{% endif %}", "{{ f(1) }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", NASTY), (None, 0, "user", "a"), (None, 1, None, "b"), (2, None, "user", "x"), (2, None, "user", "x")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 2, 2: 2}
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{NASTY}\nassistant\n\n".encode()).hexdigest()
    assert got[1]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


# Licenses


def alternatives(regex):
    """The alternatives of an expression that is one group of them, or itself."""
    inner = regex[2:-2] if regex.startswith(" (") and regex.endswith(") ") else None
    depth, out = 0, [""]
    for c in inner or regex:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return [regex]
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def test_license_rules_have_their_keyword():
    table = licenses.rules()
    assert len(table) > 300 and len(licenses.SIGNATURES.strip().splitlines()) > 150
    assert all(1 <= r["priority"] <= licenses.PRIORITIES for r in table)
    for r in table:
        re.compile(r["regex"])
        for x in alternatives(r["regex"]):
            must = re.sub(r"\([^()]*\)\?", "", x)  # optional words do not count
            assert any(re.search(rf"(?<![a-z0-9]){k}(?![a-z0-9?])", must) for k in r["keywords"]), r


def scan(spark, *texts):
    return licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()


def test_base_places(spark):
    text = "x Under the MIT license, under-the mit licenseS under the mit license. CC BY-NC cc by nc Apache License, Version 2.0"
    (r,) = scan(spark, text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    starts = [i for i in range(len(words)) for p, _ in licenses.BASE if words[i : i + len(p.split())] == p.split()]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(starts), min(starts), max(starts))
    assert r["base_labels"] == "apache-2,cc-by-nc,mit"


def test_containment_suppresses(spark):
    a, b, c, d = scan(spark, "released under the BSD 3-clause license", "SPDX-License-Identifier: MIT", "cc by nc sa 4.0", "nothing here, mit der Maus")
    assert (a["labels"], a["score"]) == ("bsd-3-clause", pytest.approx(4 / 6))
    assert (b["labels"], b["score"], b["n_base"]) == ("mit", pytest.approx(5 / 6), 0)
    assert c["labels"] == "cc-by-nc,cc-by-nc-sa" and c["base_labels"] == "cc-by-nc"  # the base label stays
    assert (d["labels"], d["score"]) == ("", 0.0)


def test_license_odd_rows(spark):
    got = scan(spark, None, "", "...", "ÉÀ mit", "under the mit license " * 500)
    assert [(r["n_words"], r["n_base"], r["first_word"]) for r in got] == [(0, 0, None), (0, 0, None), (0, 0, None), (2, 0, None), (2000, 500, 0)]
    assert got[-1]["last_word"] == 1996
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_texts(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice"
    gpl = "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. WITHOUT ANY WARRANTY; without even the implied warranty"
    got = scan(spark, mit, bsd, gpl, "GPL-2.0-or-later with Classpath-exception-2.0", "Alle Rechte, nichts weiter; der Himmel ist blau")
    assert [r["labels"] for r in got] == ["mit", "bsd", "gpl,gpl-2.0-or-later,warranty-disclaimer", "classpath-exception,gpl-2.0-or-later", ""]


def test_a_long_text_of_one_phrase(spark):
    scan(spark, "under the mit license")
    began = time.time()
    (r,) = scan(spark, "x under the mit license " * 4000)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (20_000, 4000, 1, 19_996, "mit")
    assert time.time() - began < 10  # 2 s alone on a core; a cost that grows with the square takes minutes


def test_license_repeats_and_clashing_columns(spark):
    rows = [(1, "cc by nc", 5, "a"), (1, "cc by nc", 5, "a"), (None, "cc by nc", 1, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["labels"]) for r in got) == [("1", 3, "cc-by-nc"), ("1", 3, "cc-by-nc"), ("None", 3, "cc-by-nc")]


# Decontamination


def plain(text):
    folded = "".join(c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, threshold=0.8):
    out = set()
    for item, text in items:
        words = plain(text)
        k = min(5, len(words))
        own = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
        for doc, body in docs:
            w = plain(body)
            held = own & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            if own and len(held) >= threshold * len(own) - 1e-9:
                out.add((doc, item))
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 30, 80])))) for i in range(40)] + [(90, None), (91, ""), (92, "!!"), (None, "a b")]
    docs = []
    for d in range(60):
        body = rng.choices(words, k=rng.choice([0, 20, 400]))
        for _ in range(2):
            copy = (items[rng.randrange(40)][1]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "changed"
            body[len(body) // 2 : len(body) // 2] = copy
        docs.append((d, ", ".join(body).upper() if d % 3 else " ".join(body)))
    docs += [(70, None), (71, "")]
    want = brute(docs, [x for x in items if x[0] is not None])
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_items(*tables).collect()} == want
    in_blocks = decontam.find_items(*tables, block_shingles=60)
    assert {(r["doc_id"], r["item_id"]) for r in in_blocks.collect()} == want and in_blocks.count() == len(want)
    kept = {r["doc_id"] for r in decontam.clean(*tables, block_shingles=60).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_of_odd_rows(spark):
    """Shingles of more words than the usual, documents without an id, repeated rows, a very long text, clashing columns."""
    item = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    rows = [(1, f"so {item} end"), (None, f"{item} again"), (2, item.replace("six", "sixth")), (1, f"so {item} end"), (3, f"{long} {item} {long}"), (4, long), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("n_found", F.lit("x"))
    items = spark.createDataFrame([(7, item), (7, item), (None, long), (8, None)], "item_id long, text string")
    for k in (5, 8, 11):
        found = sorted((r["doc_id"] or 0, r["item_id"], r["containment"]) for r in decontam.find_items(docs, items, k=k).collect())
        assert found == [(0, 7, 1.0), (0, 7, 1.0), (1, 7, 1.0), (1, 7, 1.0), (1, 7, 1.0), (1, 7, 1.0), (3, 7, 1.0), (3, 7, 1.0)]
        kept = decontam.clean(docs, items, k=k)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6]


def test_decontamination_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "x"), (None, "d", "y")], "doc_id long, text string, item_id string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_items(docs, items).count() == 0
    assert decontam.clean(docs, items).columns == ["doc_id", "text", "item_id"]
    assert decontam.find_items(docs.where("false"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_words_of_slices_do_not_run_together():
    from pixelloom.llm import text as T

    ((_, _, offsets, raw),) = T.slices(pa.array(["ab", "cd", None, "", "e f"]))
    w = T.words(offsets, raw)
    assert np.diff(w.first).tolist() == [1, 1, 0, 0, 2]
