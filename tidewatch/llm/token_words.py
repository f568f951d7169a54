"""Pieces between white space and normalized words as units of tokenization.

The normalizer composes letters, makes white space one space and lowers letters;
the splitter then cuts words that no merge crosses. So a text's ids are the ids
of its words one after another, and each distinct word is encoded once.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

#: str.split takes these for white space, Unicode does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_PIECE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: The splitter pattern that the word vocabulary has (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT = r"'(?:s|t|re|ve|m|ll|d)"
#: The same words where all numbers are decimal digits.
_QUICK = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")


@lru_cache(maxsize=1)
def _library_steps():
    from tokenizers import Regex, normalizers, pre_tokenizers

    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return normal, pre_tokenizers.Split(Regex(_PATTERN), "removed", invert=True)


def normal_words(piece: str) -> list[str]:
    """Normalized words of a piece without white space."""
    return words_of_pieces([piece])[0]


def words_of_pieces(some: list[str]) -> list[list[str]]:
    """Normalized words of each piece; pieces hold no white space.

    Signs that this Python's Unicode does not know, other numbers than digits and
    separators are rare and go through the library's own steps. All other pieces
    are normalized as one text, a piece a line.
    """
    joined = "\n".join(some)
    # The separators are control signs as well.
    odd = {c for c in set(joined) if c != "\n" and unicodedata.category(c) in ("Cn", "Nl", "No", "Cc")}
    doubtful = re.compile(f"[{re.escape(''.join(sorted(odd)))}]").search if odd else (lambda piece: None)
    strange = [bool(doubtful(piece)) for piece in some]
    # Each letter is lowered by itself: no final form of sigma.
    plain = "\n".join([piece for piece, is_strange in zip(some, strange) if not is_strange])
    lines = iter(unicodedata.normalize("NFC", plain).replace("Σ", "σ").lower().split("\n"))
    found = []
    for piece, is_strange in zip(some, strange):
        if is_strange:
            normal, split = _library_steps()
            found.append([word for word, _ in split.pre_tokenize_str(normal.normalize_str(piece))])
        else:
            found.append(_QUICK.findall(next(lines)))
    return found


class WordSplitter:
    """Words of a text as the vocabulary file's normalizer and splitter give them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] is None:
            raise ValueError("this splitter knows NFC, white space and lower case, and word ends")
        splits = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        if [s["pattern"]["Regex"] for s in splits] != [_PATTERN]:
            raise ValueError("this splitter knows one pattern of words")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def ready(self) -> WordSplitter:
        names = "|".join(map(re.escape, self.special)) or r"(?!)"
        self._special = re.compile(f"({names})")
        return self

    def pieces(self, text: str) -> list[str]:
        """Runs without white space. The splitter drops white space, and no word holds any."""
        if any(sign in text for sign in _SEPARATORS):
            return _PIECE.findall(text)
        return text.split()

    def words(self, piece: str) -> list[str]:
        """Words of a piece; special strings stand as they are, which no word can."""
        found: list[str] = []
        for part in self._special.split(piece) if any(name in piece for name in self.special) else [piece]:
            if part in self.special:
                found.append(part)
            else:
                found += normal_words(part)
        return found

    def words_of(self, some: list[str]) -> list[list[str]]:
        """``words`` of many pieces at once."""
        found = words_of_pieces(some)
        for at, piece in enumerate(some):
            if self._special.search(piece):
                found[at] = self.words(piece)
        return found


class Generations(dict):
    """A memo in two generations: when the young one is full it becomes the old one,
    and what is still in use moves back, so common entries survive."""

    def __init__(self, most: int):
        super().__init__()
        self._most, self._old = most, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that are in neither generation. All others are in the young one then."""
        lacking = [key for key in keys if key not in self]
        if len(self) + len(lacking) > self._most:
            self._old = dict(self)
            self.clear()
            lacking = list(keys)
        old = self._old
        self.update((key, old[key]) for key in lacking if key in old)
        return [key for key in lacking if key not in old]


class PieceIds(Generations):
    """Ids by piece, as bytes. Pieces share words, and words are what costs time."""

    def __init__(self, splitter: WordSplitter, encode_all, kind: str, pieces=500_000, words=400_000):
        super().__init__(pieces)
        self._splitter, self._encode_all, self._kind = splitter, encode_all, kind
        self._words = Generations(words)

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the pieces of these texts that are not known yet."""
        new = self.missing(set().union(*texts))
        if not new:
            return
        split = self._splitter.words_of(new)
        lacking = self._words.missing(set().union(*split))
        self._words.update((word, array(self._kind, ids).tobytes()) for word, ids in zip(lacking, self._encode_all(lacking)))
        held = self._words
        self.update((piece, b"".join([held[word] for word in some])) for piece, some in zip(new, split))


_kept: dict = {}


def kept_by_worker(name: tuple, make):
    """A look-up structure that the tasks of one Python worker share."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def library_encoder(path: str):
    """words -> ids by the tokenizers library; the words are normalized already."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.normalizer = normalizers.Sequence([])
    return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
