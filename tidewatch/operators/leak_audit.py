"""Find real names in texts that must hold tokens only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


#: Characters of a text that are searched at once.
_PIECE = 65_536


def matches_anywhere(text: Column, pattern: Column) -> Column:
    """What ``pattern`` matches at each place of a text, places that overlap included.

    The look-ahead is tried at every place in one walk, where a substring call
    per place would start over each time.
    """
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=("), pattern, F.lit("))")), F.lit(1))


def name_classes(names: DataFrame) -> list[Row]:
    """One row for each power of two that is the ``width`` of names, with their first characters.

    Wider classes look at more places. A place has as many characters as the
    alphabet of the names, whatever their number.
    """
    widest = names.agg(F.max("width")).first()[0] or 0
    places = [
        F.sort_array(F.collect_set(F.substring("name", at, 1))).alias(f"at{at}")
        for at in range(1, widest.bit_length() + 1)
    ]
    return names.groupBy("width").agg(*places).orderBy("width").collect() if widest else []


def window_pattern(found: Row) -> str:
    """Pattern of what a name of one class may fill: known first characters, the rest of a head, up to a full name."""
    width = found["width"]
    known = [found[f"at{at}"] for at in range(1, width.bit_length() + 1)]
    start = "".join("[" + "".join(f"\\x{{{ord(c):x}}}" for c in place) + "]" for place in known)
    sure = max(width - len(known), 0)
    return f"{start}.{{{sure}}}.{{0,{2 * width - 1 - len(known) - sure}}}"


def pieces(text: Column, longest: int) -> Column:
    """A text in pieces of bounded size, each with the start of the next, so that no name is cut."""
    pattern = F.lit(f"(?s)(.{{1,{_PIECE}}})(?=(.{{0,{longest - 1}}}))")
    cut = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda piece, more: F.concat(piece, more),
    )
    return F.when(F.length(text) > _PIECE, cut).otherwise(F.array(text))


def leaks(
    texts: DataFrame,
    dictionary: DataFrame,
    key_cols: Sequence[str],
    text_col: str = "text",
) -> DataFrame:
    """Every ``(key, name)`` such that the text of the key contains the name.

    Names fall into classes by length: the head of a name is as long as the
    largest power of two that fits, so a name is shorter than two heads and short
    names do not widen the search for long ones. Every text is read once:

    1. At each place where a head of a class may start, the window that the longest
       name of the class would fill is cut out. Repeated windows of a piece of text
       count once.
    2. The head of a window meets the distinct heads in an equality join. A head is
       one row however many names share it, so this join never multiplies rows.
    3. What is left of a window, cut to the lengths of names with this head, meets
       the names.

    So a name is compared where its head stands, and nowhere else: the work is
    linear in the length of a text. ``key_cols`` identify a text.
    """
    keys = list(key_cols)
    names = (
        dictionary.select("name")
        .where(F.length("name") > 0)
        .distinct()
        .withColumn("width", F.expr("shiftleft(1, length(bin(length(name))) - 1)"))
    )
    classes = name_classes(names)
    if not classes:
        return texts.select(*keys).withColumn("name", F.lit("")).limit(0)
    heads = names.groupBy("width", F.col("name").substr(F.lit(1), F.col("width")).alias("head")).agg(
        F.collect_set(F.length("name")).alias("lengths")
    )

    def windows(found: Row) -> Column:
        cut = F.array_distinct(matches_anywhere(F.col("_piece"), F.lit(window_pattern(found))))
        return F.transform(cut, lambda window: F.struct(F.lit(found["width"]).alias("width"), window.alias("window")))

    longest = 2 * classes[-1]["width"] - 1
    cut = texts.where(F.length(text_col) > 0).select(*keys, F.explode(pieces(F.col(text_col), longest)).alias("_piece"))
    met = cut.select(*keys, F.inline(F.concat(*map(windows, classes))))
    head = F.col("window").substr(F.lit(1), F.col("width")).alias("head")
    hits = met.select(*keys, "width", "window", head).join(heads, ["width", "head"])
    reached = F.filter("lengths", lambda size: size <= F.length("window"))
    spelled = hits.select(*keys, F.explode(F.transform(reached, lambda size: F.left("window", size))).alias("name"))
    return spelled.join(names.select("name"), "name", "left_semi").select(*keys, "name").distinct()
