"""Selection by the log-likelihood ratio of hashed n-grams, in DataFrame functions only.

Words and word pairs of every text fall into hash bins. Two multinomials over
the bins are counted: one from all documents (raw), one from the trusted ones
(labelled with quality 1). A document's mean is the mean over its n-grams of
``log p_trusted - log p_raw``, where its own n-grams are taken out of both
counts, so a labelled document is judged as any other. The trusted share of a
bin is drawn to the trusted share of all n-grams with the weight of PRIOR
n-grams; a bin that no other document has so adds nothing.

The cut is the one with the fewest errors on all labelled documents that pass
the base rules (in the middle of its gap, the lowest if several are as good).
The score is the mean less the cut; a document is kept if the score reaches the
threshold 0 and the base rules hold. So size and mix of a table move no verdict
by a fixed number.

Two passes over the texts. The first sums n-grams per bin before its shuffle, so
at most one row for each bin and task moves. The second shuffles one short row a
document: the counts are arrays of fixed length, read as a scalar subquery, and
each document gets its mean both as a trusted and as another one. Its rows,
without texts, are written once; labels meet those. The cut is found from counts per step of the
mean, of which there are a fixed number at most.

Word windows are compared by 64-bit hashes within one document.

Defined results: a null text has no words, so it fails the base rules; a
document without n-grams, or without other trusted ones, has mean 0; missing or
null labels are not trusted; if several labels of one document differ, one with
quality 1 decides; without labels of both qualities the cut is LOWEST, so only
base rules drop; equal rows give equal rows; an empty table gives no rows;
other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.storage import store

#: Hash bins, and the score (mean less cut) from which documents are kept.
BINS, THRESHOLD = 1 << 16, 0.0
#: N-grams that the overall trusted share weighs in a bin.
PRIOR = 3.0
#: Steps of the mean per unit in the search for the cut, and a cut below every mean.
STEPS, LOWEST = 2000, -100.0

_BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"


def _once(value: Column) -> Column:
    """A generator of one row: later uses read the value instead of computing it again."""
    return F.explode(F.array(value))


def _pairs(left: Column, right: Column, most: Column, combine) -> Column:
    return F.zip_with(F.slice(left, 1, most), right, combine)


def split_texts(docs: DataFrame) -> DataFrame:
    """The rows with ``text`` (null: empty) and its ``words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN))
    return docs.withColumn("text", text).withColumn("words", _once(split))


def hash_words(split: DataFrame) -> DataFrame:
    """Replace text and words by word hashes ``h1`` and pair hashes ``h2``; rows get short before they pass on."""
    hashes = split.withColumn("h1", _once(F.transform("words", lambda word: F.xxhash64(word)))).drop("text", "words")
    most = F.greatest(F.size("h1") - 1, F.lit(0))
    return hashes.withColumn(
        "h2", _once(_pairs(F.col("h1"), F.slice("h1", 2, most), most, lambda a, b: F.xxhash64(a, b)))
    )


def bin_of(value: Column) -> Column:
    """The low bits; never null, so that arrays of bins are sorted as plain numbers."""
    return value.bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int")


def _by_document(labels: DataFrame) -> DataFrame:
    """doc_id, quality; labels grow with the corpus, so the join is one that grows in proportion at every size.

    A task holds the labels of its ids, one of each; the texts that meet them need no sort.
    """
    return labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).hint("shuffle_hash")


def bin_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``raw`` and ``trusted`` n-grams of each bin, and their sums."""
    marked = docs.select("doc_id", "text").join(_by_document(labels), "doc_id", "left")
    grams = hash_words(split_texts(marked)).select(
        F.coalesce("quality", F.lit(0)).cast("long").alias("trusted"), F.explode(F.concat("h1", "h2")).alias("gram")
    )
    counts = grams.groupBy(bin_of(F.col("gram")).alias("bin")).agg(
        F.count("*").alias("raw"), F.sum("trusted").alias("trusted")
    )
    # From here on a row is a bin. Bins without n-grams come from the id range.
    every = docs.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").select(
        "bin",
        F.coalesce("raw", F.lit(0)).alias("raw"),
        F.coalesce("trusted", F.lit(0)).alias("trusted"),
    )
    return full.agg(
        F.array_sort(F.collect_list(F.struct("bin", "raw", "trusted"))).alias("bins"),
        F.sum("raw").alias("all_raw"),
        F.sum("trusted").alias("all_trusted"),
    ).select(
        F.col("bins")["raw"].cast("array<double>").alias("raw"),
        F.col("bins")["trusted"].cast("array<double>").alias("trusted"),
        F.col("all_raw").cast("double").alias("all_raw"),
        F.col("all_trusted").cast("double").alias("all_trusted"),
    )


def _shares(n: Column, counts: Column) -> dict[str, Column]:
    """Trusted share of all n-grams without the n own ones, of a document that is not trusted and of one that is."""
    rest = counts["all_raw"] - n
    return {
        "other": F.try_divide(counts["all_trusted"], rest),
        "trusted": F.try_divide(counts["all_trusted"] - n, rest),
    }


def _means(figures: DataFrame, counts: Column) -> DataFrame:
    """Replace sorted ``grams`` by ``means``, a struct of the means as an ``other`` and as a ``trusted`` document.

    A row is a document, then a run of equal bins, then a document again: the
    runs are summed where they are made, so one row a document is shuffled.
    Sums over rows are compiled, folds of arrays are not.
    """
    kept = [name for name in figures.columns if name != "grams"]
    size = F.size("grams")
    ends = F.filter(
        F.slice(F.sequence(F.lit(0), size), 2, size),
        lambda i: ~F.get("grams", i).eqNullSafe(F.get("grams", i - 1)),
    )
    # Equal rows are told apart by their number.
    numbered = figures.withColumn("n", size.cast("double")).withColumn("row", F.monotonically_increasing_id())
    runs = numbered.withColumn("ends", _once(ends)).select(
        "row", "n", *kept, "grams", "ends", F.posexplode_outer("ends").alias("at", "end")
    )
    bin_ = F.get("grams", F.col("end") - 1)
    met = runs.select(
        "row",
        "n",
        *kept,
        (F.col("end") - F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))).cast("double").alias("own"),
        F.get(counts["raw"], bin_).alias("raw"),
        F.get(counts["trusted"], bin_).alias("held"),
    )
    shares = _shares(F.col("n"), counts)
    held = {"other": F.col("held"), "trusted": F.greatest(F.col("held") - F.col("own"), F.lit(0.0))}
    less = F.col("raw") - F.col("own") + PRIOR
    sums = met.groupBy("row", "n", *kept).agg(
        *[F.sum(F.col("own") * F.ln((held[k] + PRIOR * shares[k]) / less)).alias(k) for k in held]
    )
    means = [F.coalesce(F.try_divide(k, "n") - F.ln(shares[k]), F.lit(0.0)).alias(k) for k in held]
    return sums.select(*kept, F.struct(*means).alias("means"))


def best_cut(judged: DataFrame) -> DataFrame:
    """One row with ``cut``, from rows of ``mean`` and ``quality``."""
    steps = judged.groupBy(F.floor(F.col("mean") * STEPS).alias("step")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")
    )
    one = steps.agg(
        F.sort_array(F.collect_list(F.struct("step", "good", "bad"))).alias("steps"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
    )
    places = F.transform("steps", lambda s, i: s.withField("next", F.get("steps", i + 1)["step"]))

    def lower(state: Column, s: Column) -> Column:
        errors = state["errors"] + s["good"] - s["bad"]
        better = (errors < state["least"]) & s["next"].isNotNull()
        return F.struct(
            errors.alias("errors"),
            F.when(better, errors).otherwise(state["least"]).alias("least"),
            F.when(better, (s["step"] + 1 + s["next"]).cast("double") / (2.0 * STEPS)).otherwise(state["cut"]).alias("cut"),
        )

    nothing = F.struct(F.col("bad").alias("errors"), F.col("bad").alias("least"), F.lit(LOWEST).alias("cut"))
    found = F.aggregate(places, nothing, lower, lambda state: state["cut"])
    return one.select(F.when(F.col("good") > 0, found).otherwise(F.lit(LOWEST)).alias("cut"))


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in 3-word windows that the text holds twice or more."""
    most = F.greatest(F.size("h1") - 2, F.lit(0))
    windows = rows.withColumn(
        "h3", _once(_pairs(F.col("h2"), F.slice("h1", 3, most), most, lambda a, b: F.xxhash64(a, b)))
    )
    # Most texts repeat no window; only the others are sorted. The count of distinct ones stands apart
    # from lambdas, so that it is compiled.
    distinct = windows.withColumn("n_distinct", _once(F.size(F.array_distinct("h3"))))
    nothing = F.array().cast("array<struct<h:bigint,at:int>>")
    at = F.transform("h3", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    sorted_rows = distinct.withColumn(
        "h3", _once(F.when(F.col("n_distinct") == F.size("h3"), nothing).otherwise(F.sort_array(at)))
    )

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get("h3", i - 1)["h"], F.get("h3", i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    places = F.sort_array(F.transform(F.filter("h3", repeated), lambda x: x["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("words")),
        lambda done, p: F.struct(
            (p + 3).alias("end"), (done["words"] + p + 3 - F.greatest(p, done["end"])).alias("words")
        ),
    )
    return sorted_rows.withColumn("n_repeat_words", covered["words"].cast("long"))


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base figures, score and verdict of every document."""
    counts = bin_counts(docs, labels).select(F.struct("raw", "trusted", "all_raw", "all_trusted")).scalar()
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = split_texts(docs.select("doc_id", "text")).withColumn("lines", _once(lines)).select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    figures = _repeated_words(hash_words(base)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _once(F.transform(F.concat("h1", "h2"), bin_of)).alias("grams"),
    )
    # Sorted apart from lambdas, so that the sort is compiled.
    scored = _means(figures.withColumn("grams", _once(F.sort_array("grams"))), counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Rows without texts: the labels meet these, so texts move once only.
    written = store(scored.withColumn("base_failed", failed), "rule-means")
    mean = F.when(F.col("quality") == 1, F.col("means")["trusted"]).otherwise(F.col("means")["other"])
    meant = written.join(_by_document(labels), "doc_id", "left").withColumn("mean", mean)
    cut = best_cut(meant.where(~F.col("base_failed") & F.col("quality").isNotNull())).scalar()
    return meant.withColumn("score", F.col("mean") - cut).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
        "score",
    )
