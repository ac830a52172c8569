"""Text expressions. All of them work on the whole string of every row."""
import re

from pyspark.sql import Column, functions as F

from caseloom.settings import STEM_SUFFIXES

WORD = "[a-z]{2,}"


def clean_text(text: Column) -> Column:
    """Lower-case, drop redaction masks, name amounts, keep a-z and apostrophes, single spaces.

    Everything outside a-z and ' (white space included) ends up as one space, so one
    replacement both drops foreign characters and collapses blanks."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    unmasked = F.regexp_replace(lowered, r"x{2,}", " ")
    named = F.regexp_replace(unmasked, r"\{\$[\p{Nd},.]+\}", " dollaramount ")
    return F.trim(F.regexp_replace(named, r"[^a-z']+", " "))


def word_count(clean: Column) -> Column:
    """Words of a cleaned text; an empty text has none."""
    blanks = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean == "", 0).otherwise(blanks + 1).cast("int")


def mentions(text: Column, pattern: str) -> Column:
    """1 when the lower-cased text matches, else 0. (?U): word edges know all alphabets."""
    return F.coalesce(F.lower(text).rlike("(?U)" + pattern), F.lit(False)).cast("int")


def tokens(clean: Column, stop=()) -> Column:
    """Words of two letters or more, in order, repeats kept, stop words taken out."""
    words = F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))
    stop = sorted(set(stop))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def ngrams(words: Column, n: int = 2) -> Column:
    """All 1..n-grams of a token array (n is 1 or 2)."""
    if n == 1:
        return words
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(words, 1, pairs), F.slice(words, 2, pairs), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(words, bigrams)


def grams_of(clean: str | None, stop: frozenset, n: int = 2) -> list[str]:
    """What `ngrams` of `tokens` gives for one text, inside a task: interpreted lambdas take several times as long there."""
    words = [w for w in re.findall(WORD, clean or "") if w not in stop]
    return words if n == 1 else words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def sentences(text: Column, min_words: int = 3, first: int | None = None) -> Column:
    """Sentences of a raw narrative with at least `min_words` words.

    All sentences by default; `first` keeps only the leading ones."""
    unmasked = F.regexp_replace(F.coalesce(text, F.lit("")), r"X{2,}", "")
    parts = F.split(unmasked, r"(?U)(?<=[.!?])\s+|\n+")
    kept = F.filter(parts, lambda s: F.regexp_count(s, F.lit(r"(?U)\S+")) >= min_words)
    return kept if first is None else F.slice(kept, 1, first)


def display_text(text: Column) -> Column:
    """Narrative ready to show: single spaces, {$5.00} written as $5.00, masks kept."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(spaced, r"\{\$([\p{Nd},.]+)\}", r"\$$1")


def stem(word: Column) -> Column:
    """Cut the first fitting suffix when three letters or more stay."""
    out = word
    for suffix in reversed(STEM_SUFFIXES):
        stays = F.length(word) - len(suffix)
        out = F.when(
            word.endswith(suffix) & (stays >= 3), F.substring(word, F.lit(1), stays)
        ).otherwise(out)
    return out


def text_hash(clean: Column) -> Column:
    """Group id of a cleaned text. All empty texts share one id."""
    return F.md5(clean)
