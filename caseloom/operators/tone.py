"""Tone of a narrative from a word list with valences."""
from pyspark.sql import DataFrame, functions as F

from caseloom.functions import text as X
from caseloom.functions.numbers import round_ratio
from caseloom.operators.skew import broadcast_if_small

# Fixed values of the published sentiment formula -----------------------------------
ALPHA = 15.0
NEGATIVE_UNITS = -500     # a sentence is negative at -0.05 or below
NEGATED = -0.74
BOOST = 0.293
WORDS = r"\p{L}+(?:'\p{L}+)*"
# A list this long still fits every executor; longer ones are joined by shuffle.
BROADCAST_WORDS = 200_000


def case_sentences(df: DataFrame, min_words: int = 3, first: int | None = None, text: str = "narrative") -> DataFrame:
    """(case_id, pos, sentence) of every narrative, all sentences unless `first` is given."""
    return df.select("case_id", F.posexplode(X.sentences(F.col(text), min_words, first)).alias("pos", "sentence"))


def lexicon_rows(lexicon: DataFrame) -> DataFrame:
    return broadcast_if_small(lexicon.select("token", "valence"), BROADCAST_WORDS)


def sentence_scores(df: DataFrame, lexicon: DataFrame, negations=(), boosters=(), min_words: int = 3,
                    first: int | None = None, text: str = "narrative") -> DataFrame:
    """(case_id, pos, units): score of every sentence in ten-thousandths, -10000..10000.

    s / sqrt(s * s + 15) over the sum s of the valences, rounded to four decimals. A negation
    among the three words before flips and dampens a valence, a booster right before it adds
    to it. Cases without a sentence come out once, with null `pos` and `units`."""
    kept = df.select("case_id", X.sentences(F.col(text), min_words, first).alias("_sentences"))
    split = kept.select("case_id", F.posexplode_outer("_sentences").alias("pos", "sentence"))
    words = split.select("case_id", "pos", F.regexp_extract_all(F.lower("sentence"), F.lit(WORDS), F.lit(0)).alias("words"))
    extras = []
    if negations:
        before = F.slice("words", F.greatest(F.col("at") - 2, F.lit(1)), F.least(F.col("at"), F.lit(3)))
        extras.append(F.arrays_overlap(before, F.array(*[F.lit(w) for w in negations])).alias("negated"))
    if boosters:
        extras.append(F.coalesce(F.get("words", F.col("at") - 1).isin(list(boosters)), F.lit(False)).alias("boosted"))
    tokens = words.select("case_id", "pos", "words", F.posexplode_outer("words").alias("at", "token")).select(
        "case_id", "pos", "token", *extras)
    valence = F.coalesce(F.col("valence"), F.lit(0.0))
    if boosters:
        valence = valence + F.when(F.col("boosted"), F.signum(valence) * BOOST).otherwise(0.0)
    if negations:
        valence = valence * F.when(F.coalesce(F.col("negated"), F.lit(False)), NEGATED).otherwise(1.0)
    summed = tokens.join(lexicon_rows(lexicon), "token", "left").groupBy("case_id", "pos").agg(
        F.sum(valence).alias("s"))
    score = F.col("s") / F.sqrt(F.col("s") * F.col("s") + ALPHA)
    return summed.select(
        "case_id", "pos", F.when(F.col("pos").isNotNull(), F.round(score * 10000)).cast("long").alias("units"))


def tone(df: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """(case_id, sentiment, negative_sentence_share), four decimals, 0 without sentences."""
    scores = sentence_scores(df, lexicon, **options)
    n, zero = F.count("units"), F.lit(0.0)
    negative = F.count_if(F.col("units") <= NEGATIVE_UNITS)
    return scores.groupBy("case_id").agg(
        F.coalesce(round_ratio(F.sum("units"), n, 0) / 10000.0, zero).alias("sentiment"),
        F.coalesce(round_ratio(negative, n, 4), zero).alias("negative_sentence_share"),
    )
