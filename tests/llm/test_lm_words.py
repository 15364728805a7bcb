import numpy as np
import pyarrow as pa

from veinlode.llm import lm_scoring


def test_words_of_many_texts_at_once():
    """The same words as text by text, whatever their blanks and characters."""
    texts = ["", None, " ", "a", "  a\tB\x0bb\x0c\r\n", "É Ünï ÀA A A  x", "a\x1cb \x85 c", "\x00 A\x00", "İI ẞ ſ", "b a b"]
    for own in (texts, texts[-1:], [None], texts[3:4] * 3):
        n, words, at = lm_scoring.split(pa.array(own, pa.string()))
        words = words.to_pylist()
        assert n.tolist() == [len(lm_scoring.tokens(t)) for t in own] and len(set(words)) == len(words)
        assert [words[i] for i in at] == [w for t in own for w in lm_scoring.tokens(t)]


def test_a_word_is_looked_up_once_for_all_its_tokens():
    vocab = lm_scoring.Vocabulary([(b"a", 5), (b"b", 3)], 2, {lm_scoring.bucket(b"a"): (6, 2), lm_scoring.bucket(b"b"): (3, 1)})
    ids, kept, log, rest = vocab.look_up([b"a", b"zz", b"b"])
    assert ids.tolist() == [vocab.id[b"a"], vocab.of_bucket[lm_scoring.bucket(b"zz")], vocab.id[b"b"]] and kept.tolist() == [True, False, True]
    assert np.allclose(log, [np.log10(5.5), 0, np.log10(3.5)]) and np.allclose(rest, [0, -vocab.bucket_log[lm_scoring.bucket(b"zz")], 0])
