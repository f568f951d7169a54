"""Words of very many letters take time in proportion."""

import random
import time

import pytest

from tidewatch.llm import bpe, quality_classifier


def test_a_word_of_a_million_letters(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    automaton = bpe.compile_automaton(vocabulary).ready()
    draw = random.Random(1)
    word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(1_000_000))
    start = time.process_time()
    ids = automaton.encode_word(word)
    assert time.process_time() - start < 60
    assert 0 < len(ids) < len(word)
    part = word[:50_000]
    library = tokenizers.Tokenizer.from_file(vocabulary)
    assert automaton.encode_word(part) == library.encode(part, add_special_tokens=False).ids


def test_features_read_whole_words():
    word = b"x" * 1_000_000
    start = time.process_time()
    plain, other = quality_classifier.word_features(word + b"a"), quality_classifier.word_features(word + b"7Aa")
    assert time.process_time() - start < 20
    assert plain[1] != other[1]  # shapes differ behind the first million letters
    assert quality_classifier.shape((word + b"7Aa").decode()) == "a0Aa"
