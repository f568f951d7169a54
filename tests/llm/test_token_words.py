"""Words of pieces in bulk, and memos in two generations."""

from hypothesis import given
from hypothesis import strategies as st

from tidewatch.llm.token_words import Generations, WordSplitter, _library_steps, words_of_pieces

PIECES = st.lists(
    st.text(st.characters(exclude_categories=("Cs", "Zs", "Zl", "Zp", "Cc")) | st.sampled_from("aB9'sΣİ²Ⅷ́é"), max_size=8)
)


@given(PIECES)
def test_words_of_pieces_are_the_librarys(some):
    some = ["".join(piece.split()) for piece in some]
    normal, split = _library_steps()
    wanted = [[word for word, _ in split.pre_tokenize_str(normal.normalize_str(piece))] for piece in some]
    assert words_of_pieces(some) == wanted


def test_special_strings_stand(vocabulary):
    splitter = WordSplitter(vocabulary).ready()
    some = ["It's<|endoftext|>Ok", "plain", "<|startoftext|>"]
    assert splitter.words_of(some) == [["it", "'s", "<|endoftext|>", "ok"], ["plain"], ["<|startoftext|>"]]


def test_common_entries_survive():
    memo, made = Generations(50), []
    for start in range(0, 400, 40):
        keys = {*range(start, start + 40), "common"}
        new = memo.missing(keys)
        made += new
        memo.update((key, str(key)) for key in new)
        assert all(memo[key] == str(key) for key in keys) and len(memo) <= 50
    assert made.count("common") == 1 and len(made) == 401
