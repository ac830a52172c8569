"""Quality rules: log-likelihood ratio of hashed n-grams (DataFrame functions only)."""
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import let, narrow

# An n-gram is a token and the one after it. Its cell is one of FIRST places of the token times one of NEXT
# places of the next, so the cells of a token add up to its own count.
FIRST, NEXT = 1 << 12, 1 << 3
# Documents whose mean log-ratio per n-gram lies below go.
THRESHOLD = -0.25
# Words are runs of anything but space and \t to \r; symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def n_dup_lines(text: str = "text") -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside a window of `width` words that stands twice or more in the text.

    Windows are compared by 64-bit hash. A text without a repeated window costs one hash set; else
    the windows are sorted with their places, and the places of repeated ones are counted in order."""
    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width)))),
            F.lit(0).cast("long"), lambda total, n: total + n)

    def repeated(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, j: F.coalesce(
            (x["h"] == F.get(s, j - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        def window(h: Column, i: Column) -> Column:
            for j in range(1, width):
                h = h.bitwiseXOR(F.shiftleft(F.get(hashes, i + j), j))
            return h
        return F.filter(F.transform(hashes, window), lambda h: h.isNotNull())

    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(
        let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h))))


def grams(text: str = "text") -> Column:
    """Cells of the n-grams of a whole text, in order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: F.transform(
        h, lambda x, i: (x.bitwiseAND(FIRST - 1) * NEXT + F.coalesce(F.get(h, i + 1), F.lit(0).cast("long")).bitwiseAND(NEXT - 1)).cast("int")))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row (ratios): by cell, ln of its share in the trusted rows over its share in all rows.

    Both multinomials are counted over all rows; the raw one is scaled to the tokens of the trusted one
    and both are smoothed by one occurrence a cell. `trusted` holds the doc_id of trusted rows; without
    any, all ratios are 0."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_own", F.lit(1))
    counts = (
        docs.select("doc_id", "text").join(narrow(ids), "doc_id", "left")
        .select(F.explode(grams()).alias("cell"), F.coalesce("_own", F.lit(0)).alias("own"))
        .groupBy("cell").agg(F.count("*").alias("raw"), F.sum("own").alias("own"))
    )
    every = docs.sparkSession.range(FIRST * NEXT).select(F.col("id").cast("int").alias("cell"))
    dense = every.join(counts, "cell", "left").fillna(0, ["raw", "own"]).agg(
        F.array_sort(F.collect_list(F.struct("cell", "raw", "own"))).alias("cells"),
        F.sum("raw").alias("all_raw"), F.sum("own").alias("all_own"))
    return dense.select(F.transform("cells", lambda x: F.when(
        (x["raw"] > 0) & (F.col("all_own") > 0),
        F.log((x["own"] + 1) / (x["raw"] * (F.col("all_own") / F.col("all_raw")) + 1))).otherwise(F.lit(0.0))).alias("ratios"))


def rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row.

    `score` is the mean log-ratio of the n-grams of the whole text between the trusted and the raw
    multinomial; a row is kept if it passes the base rules and `score` is at least `threshold`. Null and empty
    texts have no words, a null score, and fail the base. Repeated rows are judged alike and all stay; a
    score equal to the threshold is kept. Without trusted rows all scores are 0. Other columns are not read.

    The model has FIRST * NEXT numbers at any size of the corpus. It is counted when the operator is called
    and stands in the expression as one array literal; as a column it would be copied into every row."""
    known = log_ratios(docs, trusted).first()["ratios"]
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in known)), ",").cast("array<double>")
    score = let(grams(), lambda g: F.when(F.size(g) > 0, F.aggregate(
        g, F.lit(0.0), lambda total, b: total + F.get(ratios, b)) / F.size(g)))
    # equal sums whatever the order of rows: six digits
    return (
        docs.select("doc_id", "text", words().alias("words"))
        .select(
            "doc_id", F.size("words").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            n_dup_lines().alias("n_dup_lines"),
            n_repeat_words(F.col("words")).alias("n_repeat_words"),
            F.round(score, 6).alias("score"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= threshold))
    )
