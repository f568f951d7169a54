"""Token counts against the library, with a small and a large table of frequent pre-tokens."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    made = tokenizers.Tokenizer.from_file(path)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def split(path):
    return token_counts.PreTokens(path).ready()


LETTERS = st.sampled_from(" \n\t\r\xa0\x85　\x1cabzAé'sdt09²½Ⅷ٣_-<|endoftext|>ßİ中あ한😀́​")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(LETTERS, max_size=60), st.text(max_size=30).filter(lambda t: t.isprintable())))
def test_pre_tokens_sum_up_to_the_librarys_tokens(split, library, text):
    found = split.frequencies(text)
    sizes = split.sizes(list(found))
    assert sum(n * size for n, size in zip(found.values(), sizes)) == library(text)


def test_parts_of_a_long_text(split, library, monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choice(["word", " ", "  ", "\n", " it's", "<|endoftext|>", "123", "?!", "ñandú"]) for _ in range(5000))
    whole = split.frequencies(text)
    monkeypatch.setattr(token_counts, "_PART", 7)
    assert split.frequencies(text) == whole
    assert sum(n * size for n, size in zip(whole.values(), split.sizes(list(whole)))) == library(text)


@pytest.mark.parametrize("frequent", [0, 5, 400_000])
def test_every_document_as_the_library_counts_it(spark, odd, odd_rows, path, library, frequent):
    rows = token_counts.count_tokens(odd, path, frequent=frequent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    wanted = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 512) for i, t in odd_rows]
    assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)


def test_no_rows(nothing, path):
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_bound_of_the_frequent_table(spark):
    rows = [(f"w{n}", 2 ** (n // 10), 1) for n in range(100)] + [("x" * 40, 10_000, 9)]
    words = spark.createDataFrame(rows, "piece string, times bigint, n bigint")
    sizes, bound = token_counts.frequent_sizes(words, 35)
    assert len(sizes) == 30 and bound == 2**7 and "x" * 40 not in sizes
    assert len(token_counts.frequent_sizes(words, 1000)[0]) == 100


def test_other_vocabularies_are_refused(vocabulary):
    with pytest.raises(ValueError):
        token_counts.PreTokens(vocabulary)
