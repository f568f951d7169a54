import random

import pytest

#: Names that the operators use inside, as columns of the input.
CLASHING = (
    "ids decoded score spans label bag hash at width words slots starts stops key node bands band copies crc"
    " h1 h2 h3 lines ratios trusted shard slot size law item_id quality text_key held_out tie part before"
    " _row _position _quality_score _raw _doc _key"
).split()


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, repeated rows and ids, a very long text, a very long word, odd letters."""
    long_text = " ".join(f"word{n % 977} the" for n in range(12_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from all of it today."),
        (1, "The quick brown fox jumps over the lazy dog and runs far away from all of it today."),
        (1, "Another text under the same id."),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\x0c\r "),
        (None, "A row without an id: mail me at a.b@c.example or call +1 (414) 555-1791."),
        (None, None),
        (5, long_text),
        (6, "x" * 50_000),
        (7, "ΑΣ Straße İstanbul <|endoftext|> it's é J̌ 1² \x1c 　 😀"),
        (8, "one"),
        (9, "same same same same same same same same same same same same same same same same same"),
        (10, "same same same same same same same same same same same same same same same same same"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, text, "en" if i else None, "s", len(text or ""), *["x"] * len(CLASHING)) for i, text in odd_rows]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(rows, kinds + "".join(f", `{name}` string" for name in CLASHING))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text: prose of few words with copies, near copies and shared passages."""
    draw = random.Random(5)
    words = [f"w{n}" for n in range(400)] + ["the", "of", "and"] * 60
    prose = lambda n: [draw.choice(words) for _ in range(n)]
    passages = [prose(60) for _ in range(4)]
    rows = []
    for number in range(160):
        text = prose(draw.randint(1, 120))
        if number % 5 == 0:
            text[10:10] = draw.choice(passages)
        if number % 7 == 0 and rows:
            text = draw.choice(rows)[1].split()
            if number % 2:
                text[draw.randrange(len(text))] = "changed"
        rows.append((number * 3 % 161, " ".join(text)))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string")
