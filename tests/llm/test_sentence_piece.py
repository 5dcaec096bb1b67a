"""Agenda encoding and decoding against the sentencepiece library."""

import hashlib
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import sentence_piece as S

SF = Path("/root/testdata/sf0.001")
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = S.AgendaEncoder(PATH)


def expected(text):
    return LIBRARY.encode(text, add_bos=True, add_eos=True)


def made(text):
    (raw,) = ENCODER.encode_batch([text])
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a\n", "\t x", "\r\n", "▁", "▁▁a ▁", " ▁", "<s> </s> <unk> <0x41>", "naïve café é", "日本語 text", "🙂🙃", "a b​c", "\x00", "﻿x", "'" * 50, "ab" * 3000, " " * 300]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert made(text) == expected(text)
    assert ENCODER.decode(made(text)) == LIBRARY.decode(made(text))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁aetions.\t")), max_size=80))
def test_any_text(text):
    assert made(text) == expected(text)
    assert ENCODER.decode(made(text)) == LIBRARY.decode(made(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, LIBRARY.get_piece_size() - 1), st.integers(0, 300)), max_size=20))
def test_decodes_any_ids(ids):
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("▁aeinorst.,\n"), st.characters(exclude_categories=["Cs"])), min_size=4, max_size=7), min_size=30, max_size=60))
def test_agendas_side_by_side(chunks):
    words = chunks + ["▁then", "▁▁▁▁▁", "☃☃☃☃☃", "aaaaa"] * 8
    want = [b"".join(i.to_bytes(4, "little") for i in ENCODER.merge(c)) for c in words]
    assert ENCODER.merge_all(words) == want


def test_small_cache_forgets_and_stays_right():
    enc = S.AgendaEncoder(PATH, cache_chunks=2)
    for text in CASES * 2:
        (raw,) = enc.encode_batch([text])
        assert raw == b"".join(i.to_bytes(4, "little") for i in expected(text))
        assert len(enc.known) <= 2 + 3 * len(set(enc.cut(text)))  # chunks, and the parts of some


def test_the_check_notices_a_difference():
    enc = S.AgendaEncoder(PATH)
    enc.merge = lambda chunk: [5]
    with pytest.raises(ValueError, match="differ"):
        enc.encode_batch(["some words"])


def test_rows(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "same", "z"), (2, "same", "z"), (3, "long words and more " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.sentencepiece_encode(df, PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()), key=str)
    want = sorted(((i, len(expected(t or "")), b"".join(x.to_bytes(4, "little") for x in expected(t or "")), LIBRARY.decode(expected(t or ""))) for i, t, _ in rows), key=str)
    assert got == want
    assert S.sentencepiece_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in S.op3_sentencepiece(spark, str(SF)).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = expected(d.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d.doc_id] == (d.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
