"""Cross-tokenizer links against the two libraries and a plain walk over both token lists."""

from __future__ import annotations

import copy
import hashlib
import random
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelloom.llm import arrays, piece_codec, pretokens, token_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = "doc_id long, text string"
ODD = [
    None, "", " ", "  a", "plain words here", "<|endoftext|> <s> </s> <0x41>", "▁", "a▁b", "日本語 テスト", "\U0001f600\U0001f468‍\U0001f469 x", "é\x00\n\tñ", " " * 50, "-" * 300, "1234 56½ ²", "it's they're 'll",
    "plain words here", "straße Größe", "a" * 700, "=\t=\r\n" * 40, " 　",
]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def plain(libraries, texts):
    """The contract, token by token."""
    a, b = libraries
    v = pretokens.vocabulary(A)
    piece = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    shown = lambda i: bytes([int(piece[i][3:5], 16)]) if b.is_byte(i) else piece[i].replace("▁", " ").encode()
    rows, corpus = [], Counter()
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        p, q = [v.bytes[i] for i in x], [shown(i) for i in y]
        if not t or b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            rows.append((0, 0, [], ""))
            continue
        ends, at = {}, 0
        for i, s in zip(x, p):
            at += len(s)
            ends[at] = [i]
        links, groups, at, i = [], [], 0, 0
        own_a, own_b, places = [], [], sorted(ends)
        for k, s in zip(y, q):
            at += len(s)
            own_b.append(k)
            if at in ends:
                while i < len(places) and places[i] <= at:
                    own_a.append(ends[places[i]][0])
                    i += 1
                links.append((own_a[-1], k))
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        corpus.update(links)
        rows.append((len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, k), n in corpus.items():
        best[k] = max(best.get(k, 0), n)
    return [(n_a, n_b, len(ls), len(ls), sum(corpus[p] == best[p[1]] for p in ls), sum(corpus[p] for p in ls), sha) for n_a, n_b, ls, sha in rows]


def texts_of(n, seed):
    draw = random.Random(seed)
    words = ["alpha", "Beta,", "straße", "日本", "12345", "\n", "  ", "\t", "x=y", "don't", "re-entry", "\U0001f600", "ﬁ", "__init__", "http://a.b/c?d=1"]
    return ["".join(draw.choice(words) + draw.choice([" ", "", "\n"]) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


def test_query_columns_on_odd_texts(spark, libraries):
    texts = [*ODD, *texts_of(150, 1), "word " * 30_000]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    got = token_links.links(spark.createDataFrame(rows, FIELDS), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = [(i, *r) for (i, _), r in zip(rows, plain(libraries, texts))]
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected)


@pytest.mark.parametrize("most", [1, 16, 1 << 20])
def test_stretches_do_not_matter(libraries, most):
    texts = [*ODD[:10], *texts_of(6, 2)]
    block = next(arrays.blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], most=1 << 30))
    v = copy.copy(pretokens.vocabulary(A))
    v.special = b""
    with duckdb.connect() as con:
        got = token_links.align_block(con, v, piece_codec.pieces(B), block, most)
    expected = plain(libraries, texts)
    assert list(zip(*(got.column(c).to_pylist() for c in ("n_a", "n_b", "n_groups", "groups_sha256")))) == [(r[0], r[1], r[2], r[6]) for r in expected]


def test_query_on_every_document(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter((d.doc_id, *r) for d, r in zip(docs, plain(libraries, [d.text for d in docs])))
    assert Counter(tuple(r) for r in token_links.op13_token_links(spark, sf_dir).collect()) == expected


def test_empty_table_and_other_columns(spark, libraries):
    rows = [(1, "some text", {"k": 1}, 5), (2, None, None, None)]
    odd = spark.createDataFrame(rows, FIELDS + ", _text map<string,int>, `n.a` int")
    assert [tuple(r)[1:] for r in token_links.links(odd, A, B).orderBy("doc_id").collect()] == plain(libraries, ["some text", None])
    assert token_links.links(odd.where("doc_id > 9"), A, B).collect() == []


def test_pairs_stay_below_the_bound():
    assert 1e5 < token_links.pair_bound(pretokens.vocabulary(A), piece_codec.pieces(B)) < 2e6
