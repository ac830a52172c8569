"""Row features known when a case comes in. All are projections: no shuffle."""
from pyspark.sql import DataFrame, functions as F

from caseloom import settings as S
from caseloom.functions import text as X


def outcome_flags(df: DataFrame, relief=S.RELIEF_RESPONSES, monetary=S.MONETARY_RESPONSE) -> DataFrame:
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    response = F.col("company_response")
    return df.withColumns({
        "relief": flag(response.isin(list(relief))),
        "monetary_relief": flag(response == monetary),
    })


def date_features(df: DataFrame, window=S.COMPLETE_MONTHS) -> DataFrame:
    """Month key, days until the company got the case, complete-month flag (both ends in)."""
    month = F.date_format("date_received", "yyyy-MM")
    return df.withColumns({
        "month": month,
        "days_to_company": F.datediff("date_sent_to_company", "date_received"),
        "complete_month": F.coalesce(month.between(*window), F.lit(False)).cast("int"),
    })


def segment_flags(df: DataFrame, tags: dict[str, str] = S.SEGMENT_TAGS) -> DataFrame:
    return df.withColumns({name: F.col("tags").contains(tag).cast("int") for name, tag in tags.items()})


def geo_flags(df: DataFrame, state=S.REGION_STATE, zips=S.METRO_ZIP3) -> DataFrame:
    """Region flag, and metro flag (three-digit ZIP in the metro set, inside the region)."""
    in_region = F.col("state") == state
    return df.withColumns({
        "in_region": in_region.cast("int"),
        "in_metro": (in_region & F.col("zip3").isin(list(zips))).cast("int"),
    })


def geo_code(df: DataFrame) -> DataFrame:
    """0 elsewhere, 1 region outside the metro, 2 metro."""
    return df.withColumn(
        "geo", F.when(F.col("in_metro") == 1, 2).when(F.col("in_region") == 1, 1).otherwise(0)
    )


def geo_label(df: DataFrame, labels=S.GEO_LABELS) -> DataFrame:
    return geo_code(df).withColumn(
        "geo_label",
        F.when(F.col("geo") == 2, labels[2]).when(F.col("geo") == 1, labels[1]).otherwise(labels[0]),
    )


def signal_flags(df: DataFrame, patterns: dict[str, str] = S.SIGNAL_PATTERNS,
                 text: str = "narrative") -> DataFrame:
    return df.withColumns({name: X.mentions(F.col(text), p) for name, p in patterns.items()})


def text_features(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Cleaned narrative, its word count and its text group."""
    cleaned = df.withColumn("narrative_clean", X.clean_text(F.col(text)))
    return cleaned.withColumns({
        "narrative_words": X.word_count(F.col("narrative_clean")),
        "text_group": X.text_hash(F.col("narrative_clean")),
    })


def scaled_log_words(df: DataFrame, words: str = "narrative_words") -> DataFrame:
    """log(1 + words) on a 0..1 scale; the largest count comes from a scalar subquery."""
    largest = df.agg(F.max(words)).scalar()
    return df.withColumn("log_words", F.log1p(F.col(words)) / F.log1p(largest))


def route_correct(df: DataFrame, predicted: str = "route_pred", actual: str = "product") -> DataFrame:
    """1.0 right, 0.0 wrong, null where nothing was predicted."""
    right = (F.col(predicted) == F.col(actual)).cast("double")
    return df.withColumn("route_correct", F.when(F.col(predicted).isNotNull(), right))
