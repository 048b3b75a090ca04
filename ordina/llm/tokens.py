"""Token ids of whole texts, with the ids of words met before looked up."""

from __future__ import annotations

import json
import os
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHED_WORDS = 800_000
WORDS_AT_ONCE = 200
MARKS = string.punctuation.replace("'", "")  # closing ones; the splitter has rules for the apostrophe

# The normaliser and splitter under which a text's ids are those of its words.
NORMALISER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _latin(text: str) -> bool:
    """Whether the normaliser does no more to the letters of `text` than `lower`: Latin-1."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _spaced(text: str | None) -> str:
    """`text` with spaces for line feeds; small where that is what the normaliser makes of it."""
    text = (text or "").replace("\n", " ")
    return text.lower() if _latin(text) else text


class Encoder:
    """Ids of whole texts, each closed by the id `end`.

    Where the vocabulary's pieces never reach over a space or line feed, a text's ids are
    those of its words between them, one after another. A vocabulary with any other
    normaliser or splitter gets whole texts.
    """

    def __init__(self, path: str, end: int, cached: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        self.by_words = made["normalizer"] == NORMALISER and made["pre_tokenizer"] == SPLITTER
        # Small Latin-1 letters need no normaliser, and no splitter but the space between words.
        spaces = {"type": "CharDelimiterSplit", "delimiter": " "}
        as_bytes = SPLITTER["pretokenizers"][1]
        bare = {**made, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, as_bytes]}}
        self.small = Tokenizer.from_str(json.dumps(bare))
        suffix = made["model"].get("end_of_word_suffix")
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.closes[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.end, self.cached = np.array([end], "<u4"), cached
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str], tokenizer: Tokenizer | None = None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ids_of_letters(self, words: list[str], tokenizer: Tokenizer) -> list[bytes]:
        """Ids of words that are one piece each, some of them in one call.

        A piece ends where an id closes a word.
        """
        out, texts = [], [" ".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        for k, joined in enumerate(self._ids(texts, tokenizer)):
            some = words[k * WORDS_AT_ONCE : (k + 1) * WORDS_AT_ONCE]
            ends = (4 * np.flatnonzero(self.closes[np.frombuffer(joined, "<u4")]) + 4).tolist()
            if len(ends) == len(some):
                out += [joined[a:b] for a, b in zip([0, *ends], ends)]
            else:
                out += self._ids(some)
        return out

    def _learn(self, words: list[str]) -> None:
        """Letters before closing marks are pieces of their own, and small letters after lower-casing.

        Letters whose composed small form is more than letters, such as a dotted capital I,
        stay with the marks: the splitter may join what is left over with them.
        """
        plain, letters, whole, apart = set(), set(), set(), []
        for word in words:
            core = word.rstrip(MARKS)
            latin = _latin(core)
            bare = core.lower() if latin else unicodedata.normalize("NFC", core).lower()
            if not bare.isalpha():
                whole.add(word)
                continue
            if latin:
                plain.add(bare)
            else:
                bare = core
                letters.add(bare)
            if bare != word:
                apart.append((word, bare, word[len(core) :]))
                whole.add(word[len(core) :])
        known = self.known
        plain, letters, whole = (list(new.difference(known)) for new in (plain, letters, whole))
        known.update(zip(plain, self._ids_of_letters(plain, self.small)))
        known.update(zip(letters, self._ids_of_letters(letters, self.tokenizer)))
        known.update(zip(whole, self._ids(whole)))
        known.update((word, known[bare] + known[marks]) for word, bare, marks in apart)

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those not met before are learnt."""
        found = list(map(self.known.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            self._learn([words[i] for i in gaps])
            for i in gaps:
                found[i] = self.known[words[i]]
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.append(np.frombuffer(x, "<u4"), self.end) for x in self._ids([x or "" for x in texts])]
        if len(self.known) > self.cached:
            self.known = {"": b""}
        split = pc.split_pattern(pa.array([_spaced(x) for x in texts], pa.large_string()), " ")
        # Each distinct word is looked up once; its ids are then taken for every place of it.
        words = split.flatten().dictionary_encode()
        found = self._ids_of_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        whole = ids.buffers()[2]
        return [np.append(np.frombuffer(whole[a:b], "<u4"), self.end) for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end: int) -> Encoder:
    """The encoder of this process; later tasks of a worker find the words of earlier ones."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]
