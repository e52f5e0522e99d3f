"""Offset-preserving pieces against the library: ids, texts, spans, and character maps."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from panelloom.llm import arrays, piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", None, " ", "  ", " a", "a ", "a  b   c    d     e", " " * 37, "▁", "▁▁ a▁b", "a\nb\t\r\n c", "日本語 テスト é  x", "\U0001f600 \U0001f468‍\U0001f469", "\x00a\x00", "<s> </s> <unk> <0x41>",
    "a" * 500, " " * 1000, "x" * 3000, "1234 56½ ²", "ñandú Größe œuvre", "ab" * 300, "<0x0A>", "á", "�", "= " * 200, "-" * 500, "the " * 50, "Ａｂｃ ﬁ ①  ㍿ ｶﾞ ", "한국어 각", "　x　", "­­", "é̱ ",
]


def block(texts):
    return next(arrays.blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], most=1 << 30))


def check(p, library, texts):
    b = block(texts)
    ids, offs, lo, hi = piece_codec.encode_block(p, b)
    shown = piece_codec.decode_ids(p, ids, offs)
    for i, t in enumerate(texts):
        cut = slice(offs[i], offs[i + 1])
        expected = library.encode(t or "", return_type="proto").pieces
        assert ids[cut].tolist() == [x.id for x in expected] == library.encode(t or ""), t
        assert list(zip((lo[cut] - b.offs[i]).tolist(), (hi[cut] - b.offs[i]).tolist())) == [(x.begin, x.end) for x in expected], t
        assert shown[i] == library.decode(ids[cut].tolist()), t


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf"])
def mapped(request, tmp_path_factory):
    """The same pieces behind a compiled character map that also squeezes white space."""
    model = proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    rules = sentencepiece.SentencePieceNormalizer(rule_name=request.param)
    other = proto.ModelProto()
    other.ParseFromString(rules.serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path_factory.mktemp("model") / "mapped.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return piece_codec.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_odd_texts():
    check(piece_codec.pieces(PATH), LIBRARY, ODD)


def test_odd_texts_through_a_character_map(mapped):
    check(*mapped, ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet=st.sampled_from("ab etainosr  ▁.,!1é日\n<>x0AsÉ-=_/"), max_size=300), min_size=1, max_size=5))
def test_any_text(texts):
    check(piece_codec.pieces(PATH), LIBRARY, texts)


def test_any_text_through_a_character_map(mapped):
    draw = random.Random(5)
    pick = lambda: draw.choice([draw.randrange(32, 127), 32, draw.randrange(0, 0x3000), draw.randrange(0x3300, 0x3400), draw.randrange(0xFB00, 0xFFE0)])
    check(*mapped, ["".join(chr(pick()) for _ in range(draw.randrange(80))) for _ in range(300)])


def test_rounds_equal_the_heap():
    """One word of every length around the switch, merged both ways."""
    p, draw = piece_codec.pieces(PATH), random.Random(3)
    for alphabet in ("a", "-=", "aehnrst", "▁"):
        for n in (1, 2, 3, 40, piece_codec.LONG - 1, piece_codec.LONG):
            sym = p.char_id[[ord(draw.choice(alphabet)) for _ in range(n)]]
            ids, size, _ = piece_codec.merge_words(p, sym.copy(), np.zeros(n, np.int64), 1)
            assert list(zip(ids.tolist(), size.tolist())) == piece_codec._by_heap(p, sym.tolist())


@pytest.mark.parametrize("unit", ["a", " ", "-", "the ", "▁x", "日", "é0"])
def test_very_long_texts(unit):
    check(piece_codec.pieces(PATH), LIBRARY, ["x", unit * (60_000 // len(unit)), None])


def test_any_ids_decode_like_the_library():
    p, draw = piece_codec.pieces(PATH), random.Random(7)
    rows = [[draw.choice([0, 1, 2, draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randrange(12))] for _ in range(2000)]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = piece_codec.decode_ids(p, np.array([x for r in rows for x in r], np.int64), offs)
    assert got == [LIBRARY.decode(r) for r in rows]


def test_query_on_every_document(spark, sf_dir):
    got = {r.doc_id: r for r in piece_codec.op11_piece_codec(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        assert r.n_bytes == r.covered == len((d.text or "").encode())


def test_columns_with_clashing_names_and_empty_tables(spark):
    rows = [(1, "a b", "x", {"k": 1}), (1, "a b", "x", {"k": 1}), (None, None, None, None), (2, "", "é", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, _text map<string,int>")
    got = piece_codec.encode_columns(df, PATH, keep=("doc_id", "a.b", "_text"))
    assert got.columns == ["doc_id", "a.b", "_text", "ids", "starts", "ends"]
    assert sorted(str(r.ids) for r in got.collect()) == sorted(str(LIBRARY.encode(t or "")) for _, t, _, _ in rows)
    assert piece_codec.digests(df.where("doc_id > 5"), PATH).count() == 0
    assert piece_codec.digests(df.withColumnRenamed("doc_id", "n_tokens").withColumnRenamed("n_tokens", "doc_id"), PATH).count() == 4
