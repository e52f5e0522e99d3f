"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import collections
import re
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelloom.llm import bpe_codec, dart_minhash, decontaminate, pii_semicrf, shared_store
from panelloom.llm.shared_store import written


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, "no id but plain words here", "en", "x", 26), (900001, None, None, None, None), (900002, "12 34 !!", "en", "x", 8)], docs.schema)
    out = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(spark, stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[1:-1])


def test_language_keeps_clean_documents(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(before) - set(after) == {900001, 900002}


def test_one_of_each_class_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    bags = {}
    for k, r in before.items():
        w = words(r.text)
        bags[k] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    order = sorted(bags, key=lambda k: (k is None, k))
    root = {k: k for k in order}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(order):
        for b in order[:i]:
            both = sum((bags[a] & bags[b]).values())
            if both and both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
                p, q = sorted((find(a), find(b)), key=lambda k: (k is None, k))
                root[q] = p
    assert set(after) == {k for k in order if find(k) == k}


def test_leaked_documents_go(spark, sf_dir, steps):
    items = [plain_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 3]) for w in items for i in range(len(w) - 2)}
    before, after = rows(steps[2]), rows(steps[3])
    assert set(after) <= set(before)
    for k, r in before.items():
        w = plain_words(r.text)
        text = " " + " ".join(w) + " "
        if any(" " + " ".join(q) + " " in text for q in items):
            assert k not in after
        if not any(tuple(w[i : i + 3]) in grams for i in range(len(w) - 2)):
            assert k in after


def test_personal_data_is_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    field = pii_semicrf.trained()
    for k, r in before.items():
        spans = pii_semicrf.find_spans(field, [r.text])[0][1]
        assert after[k].text == pii_semicrf.masked(r.text, spans) and after[k].n_chars == len(after[k].text)
        assert spans or after[k].text == r.text


def test_tokens_are_those_of_the_library(steps):
    before, after = rows(steps[4]), rows(steps[5])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(before) == set(after)
    for k, r in before.items():
        assert after[k].ids == library.encode(r.text, add_special_tokens=False).ids and after[k].exact and after[k].n_tokens == len(after[k].ids)


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {k for k in rows(steps[5]) if k is not None}


def test_a_run_leaves_its_last_input_only(spark, tmp_path, sf_dir, monkeypatch):
    """Tables of stages and operators go when they are done with."""
    monkeypatch.setattr(shared_store, "new_folder", lambda _, kind: f"{tmp_path}/{kind}-{uuid.uuid4().hex}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [p.name for p in tmp_path.glob("*/*") if not p.name.startswith(".")] == ["personal_data"]


def test_any_columns(spark):
    """Maps, dots in names, the operators' own names, repeated ids, nulls and no rows at all."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, {"k": 1}, "a", "x", 2), (1, text, {"k": 2}, "b", "y", 3), (2, text + " end", None, None, None, None), (3, "my mail is me@b.org now", {}, "c", "z", 1), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` string, _text string, _doc int")
    kept = dart_minhash.one_of_each(spark, df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    clean = decontaminate.without_leaks(spark, df, spark.createDataFrame([(5, "word3 word4 word5 word6 word7")], "item_id long, text string"))
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["3", "None"]
    assert [r.text for r in pii_semicrf.redact(df.where("doc_id = 3")).collect()] == ["my mail is [EMAIL] now"]
    assert pii_semicrf.pii_spans(df, keep=("doc_id", "_text", "a.b", "m")).where("doc_id = 3").first()["a.b"] == "c"
    coded = bpe_codec.encode_columns(df, public_tokenizers.path("byte_bpe_50k.json"), keep=("_text", "a.b", "m"))
    assert coded.columns == ["_text", "a.b", "m", "ids", "exact"] and coded.where("exact").count() == 5
    assert dart_minhash.one_of_each(spark, df.limit(0)).columns == df.columns
