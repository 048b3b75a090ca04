"""Ids by words against the tokenizer on whole texts."""

from __future__ import annotations

import unicodedata

import public_tokenizers
import pytest

from ordina.llm.tokens import MARKS, Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizers.path("word_bpe_49k.json"), 2, cached=10**9)


def whole(encoder, texts):
    return [[*e.ids, 2] for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_every_letter_before_every_mark(encoder):
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    words = [f"{c}{MARKS[i % len(MARKS)]}" for i, c in enumerate(letters)]
    words += [f"a{c}{m}" for c in letters if ord(c) < 0x600 for m in MARKS]
    assert [x.tolist() for x in encoder.encode(words)] == whole(encoder, words)


def test_texts(encoder):
    texts = [
        "TAKSİ.", "İSTANBULLU EVLİLİĞİ, sonra", "SİGORTASI BİTTİ!", "ΟΔΟΣ. ΟΔΟΣ", "été, Eté.", "יִ. x",
        "a b　c\n\nd", "don't 'S I'VE.", "ǅ! ﬁ; ß?", "", " \n ", "１２ ½ x2.", "한국어. 日本語。 中文, ไทย.",
    ]
    assert encoder.by_words
    assert [x.tolist() for x in encoder.encode(texts)] == whole(encoder, texts)
    assert [x.tolist() for x in encoder.encode([None])] == [[2]]


def test_other_vocabularies_get_whole_texts():
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert not other.by_words
    assert [x.tolist() for x in other.encode(["Two  words.\n\nx", None])] == [*whole(other, ["Two  words.\n\nx"]), [2]]


def test_each_distinct_word_is_looked_up_once():
    asked = []

    class Known(dict):
        def get(self, word):
            asked.append(word)
            return super().get(word)

    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    encoder.known = Known(encoder.known)
    texts = ["The the Été. été.\n" * 500, None, "THE  été."]
    assert [x.tolist() for x in encoder.encode(texts)] == whole(encoder, [x or "" for x in texts])
    assert sorted(asked) == ["", "the", "été."]


def test_latin_letters_and_marks(encoder):
    """All pairs of Latin-1 characters, in a text of them alone and beside another letter."""
    latin = [chr(c) for c in range(256)]
    for a in latin:
        pairs = " ".join(f"{a}{b}" for b in latin)
        texts = [pairs, f"{pairs} ł", pairs.replace(" ", " É") + " <|ENDOFTEXT|> K\u212a. E\u0301 H\u0331!"]
        assert [x.tolist() for x in encoder.encode(texts)] == whole(encoder, texts)
