import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veinlode.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
VOCAB = pieces.load()
PLAIN, DROPS, OTHER = pieces.Codec(VOCAB, 0.0), pieces.Codec(VOCAB, 0.2), pieces.Codec(VOCAB, 0.2, seed=99)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
SAMPLE = "The  quick brown fox\n\tjumps über naïve straße 12345 times. 日本語 😀 <s> <0x0A> </s> Internationalisation"


def test_plain_is_the_library_s(spark):
    texts = [SAMPLE, "a" * 500, "x  y   z", " lead", "trail ", "\n\n", " "] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert PLAIN.encode(t) == LIBRARY.encode(t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tab▁<s>")), max_size=80))
def test_lossless(text):
    for codec in (PLAIN, DROPS):
        assert codec.decode(codec.encode(text)) == text


def test_dropout_varies_and_repeats():
    text = SAMPLE * 20
    assert DROPS.encode(text) == pieces.Codec(VOCAB, 0.2).encode(text)
    assert DROPS.encode(text) != OTHER.encode(text) != PLAIN.encode(text)
    assert len(DROPS.encode(text)) > len(PLAIN.encode(text))
    words = {DROPS.segment(" Internationalisation", v) for v in range(pieces.VARIANTS)}
    assert len(words) > 1
    everything = pieces.Codec(VOCAB, 1.0)
    assert len(everything.encode("hello you")) == len(" hello you")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from(" etaoinshrTHE,.é😀\t"), min_size=1, max_size=39), min_size=1, max_size=30))
def test_side_by_side_is_one_by_one(chunks):
    variants = [len(c) % pieces.VARIANTS for c in chunks]
    for codec in (PLAIN, DROPS):
        own = variants if codec is DROPS else [0] * len(chunks)
        assert codec.segment_many(chunks, own) == [codec.segment(c, v) for c, v in zip(chunks, own)]


def test_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, SAMPLE, "c"), (3, SAMPLE, "c"), (None, "word " * 50000, None), (5, "y" * 200000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_x string")
    got = pieces.decode(pieces.encode(docs)).collect()
    assert len(got) == 6 and all(r.decoded == r.text for r in got)
    assert [r.piece_ids for r in got if r.doc_id in (1, 2)] == [None, []]
    same = [r.piece_ids for r in got if r.doc_id == 3]
    assert same[0] == same[1]
    assert pieces.encode(docs.where("false")).count() == 0


def test_query_is_lossless(spark):
    got = pieces.op5_pieces(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.lossless for r in got)
