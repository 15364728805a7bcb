import pytest

from veinlode.llm import pieces

pytest.importorskip("sentencepiece")


def test_occurrences_are_dropped_independently():
    codec = pieces.Codec(pieces.load(), 0.2)
    word, n = " Internationalisation", 600
    seen = set()
    for k in range(n):
        text = f"t{k}" + word
        ids = tuple(codec.encode(text))
        chunks = codec.chunks.findall(" " + text)
        variants = codec._pick(text, len(chunks)).tolist()
        parts = [codec.segment(c, v) for c, v in zip(chunks, variants)]
        assert ids == tuple(i for p in parts for i in p)
        seen.add(parts[-1])
    assert len(seen) > 20  # two before
    again = codec.encode(word[1:] * 50)
    assert again == pieces.Codec(pieces.load(), 0.2).encode(word[1:] * 50)
