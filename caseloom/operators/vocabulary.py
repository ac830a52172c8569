"""Terms, vocabulary and TF-IDF as long tables (case_id, term, ...)."""
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from caseloom import settings as S
from caseloom.functions import text as X
from caseloom.operators.prefix import running
from caseloom.plans.lineage import cut

TABLE_TERMS = 100_000      # of a term table that a task holds before it hands them on


def default_stop_words() -> list[str]:
    """General English list that ships with Spark, and the domain list. Needs a session."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")) | set(S.DOMAIN_STOP_WORDS))


def counted(grams: Column) -> Column:
    """Terms of a row as sorted (term, tf): equal ones are counted where the row is, as runs of its sorted terms."""
    held = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  computed once a row

    def runs(grams: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: (i == 1) | (F.get(grams, i - 1) != F.get(grams, i - 2)))
        terms = held(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(grams, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(grams) + 1) - i).cast("long").alias("tf"))))
        return F.when(F.size(grams) > 0, terms).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return held(F.sort_array(grams), runs)


def term_counts(df: DataFrame, text: str = "narrative_clean", key: str = "case_id", stop=(), n: int = 2,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, term, tf) over 1..n-grams.

    The texts of a key meet before they are taken apart, and its terms are counted in one row: texts are several times
    smaller than their n-grams, which are neither exchanged nor spilled."""
    texts = df.select(key, *carry, F.col(text).alias("_text")).where("_text IS NOT NULL").groupBy(key, *carry).agg(
        F.collect_list("_text").alias("_texts"))
    words = F.transform("_texts", lambda t: X.tokens(t, stop))
    grams = F.flatten(F.transform(words, lambda w: X.ngrams(w, n)))
    return texts.select(key, *carry, counted(grams).alias("terms")).select(key, *carry, F.inline("terms"))


def term_table(df: DataFrame, text: str = "narrative_clean", key: str = "case_id", stop=(), n: int = 2,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, terms) with one row a case and its terms as (term, tf), written: texts are taken apart
    once, whatever the number of vocabularies and folds that read the table. Equal terms are counted where the case is:
    nothing moves. A case without words has no terms."""
    kept, left_out = [df.schema[c] for c in (key, *carry)], frozenset(stop)
    terms = StructType([StructField("term", StringType()), StructField("tf", LongType())])

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            low, own, ends = 0, [], [0]
            for i, text in enumerate(batch.column("_text"), 1):
                own += sorted(Counter(X.grams_of(text.as_py(), left_out, n)).items())
                ends.append(len(own))
                if i == len(batch) or len(own) >= TABLE_TERMS:
                    held = pa.StructArray.from_arrays(
                        [pa.array([t for t, _ in own], pa.string()), pa.array([k for _, k in own], pa.int64())], ["term", "tf"])
                    part = batch.slice(low, i - low)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(f.name) for f in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)],
                        [*[f.name for f in kept], "terms"])
                    low, own, ends = i, [], [0]

    schema = StructType([*[StructField(f.name, f.dataType) for f in kept], StructField("terms", ArrayType(terms))])
    return cut(df.select(key, *carry, F.col(text).alias("_text")).mapInArrow(run, schema))


def counts_of(table: DataFrame, key: str = "case_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """What `term_counts` gives, from a written term table. Cases are hashed before their terms part, so
    counts, norms and vectors need no exchange of terms."""
    return table.repartition(key).select(key, *carry, F.inline("terms"))


def term_stats(counts: DataFrame, *by: str) -> DataFrame:
    """(by, term, total, df): uses of every term and cases that use it."""
    return counts.groupBy(*by, "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def most_frequent(terms: DataFrame, size: int) -> DataFrame:
    """The `size` terms with the highest total, ties in alphabetical order.

    The total of the last term kept is found first, from the number of terms per total, so
    that only terms at or above it are sorted. `terms` is written first, as both steps read it."""
    terms = cut(terms)
    per_total = running(terms.groupBy("total").agg(F.count("*").alias("n")), [F.desc("total")], {"before": "n"})
    floor = per_total.where(F.col("before") + F.col("n") >= size).agg(F.max("total")).scalar()
    return (
        terms.where(F.col("total") >= F.coalesce(floor, F.lit(0)))
        .orderBy(F.desc("total"), F.asc("term")).limit(size)
    )


def select_terms(stats: DataFrame, n: Column, min_df: int, max_df: float, size: int) -> DataFrame:
    """(term, idx, total, df, idf): document-frequency bounds, then the `size` most frequent.

    `idx` numbers the terms alphabetically from 0, in one list of `size` terms at most; `n` is the number of cases
    behind `stats`."""
    bounded = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n))
    kept = most_frequent(bounded, size).agg(F.sort_array(F.collect_list(F.struct("term", "total", "df"))).alias("kept"))
    return kept.select(F.posexplode("kept").alias("idx", "t")).select(
        "t.term", "idx", "t.total", "t.df", (F.log((n + 1) / (F.col("t.df") + 1)) + 1).alias("idf"))


def vocabulary(counts: DataFrame, docs: DataFrame, min_df: int, max_df: float, size: int) -> DataFrame:
    """Vocabulary of the cases `docs` that `counts` came from."""
    return select_terms(term_stats(counts), docs.agg(F.count("*")).scalar(), min_df, max_df, size)


def tfidf(counts: DataFrame, vocab: DataFrame, key: str = "case_id", sublinear: bool = True) -> DataFrame:
    """(key, idx, weight), unit length per case. Fits new text as well as the text of the fit.

    A vocabulary has at most the `size` it was cut to, which makes the broadcast safe; a term
    used in every case then stays where its cases are."""
    tf = F.log(F.col("tf")) + 1 if sublinear else F.col("tf")
    weighted = counts.join(F.broadcast(vocab.select("term", "idx", "idf")), "term").select(
        key, "idx", (tf * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "idx", (F.col("raw") / norm).alias("weight"))


def looked_up(table: DataFrame, terms: list[str], factors: list[float] | None = None, key: str = "case_id") -> DataFrame:
    """(key, at, raw): places in the list `terms` of the terms that a key has in a written term table, rising, and
    log(tf) + 1, times the term's factor.

    Terms are looked up where the case is, so numbers move and no terms. Rows of one key come together; a key without any of
    the terms has no row. The list is cut to size by its fit."""
    shared = table.sparkSession.sparkContext.broadcast((terms, factors))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, factors = shared.value
        factors = np.ones(len(terms)) if factors is None else np.asarray(factors)
        for batch in batches:
            lists = batch.column("terms")
            found, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            term = pc.struct_field(found, "term")
            at = pc.fill_null(pc.index_in(term, value_set=pa.array(terms, term.type)), -1).to_numpy()
            known = at >= 0
            row, at = np.repeat(np.arange(len(sizes)), sizes)[known], at[known]
            raw = (np.log(pc.struct_field(found, "tf").to_numpy()[known]) + 1) * factors[at]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), raw)]], ["key", "at", "raw"])

    kind = table.schema[key].dataType.simpleString()
    rows = table.select(key, "terms").mapInArrow(run, f"key {kind}, at array<int>, raw array<double>").where(F.size("at") > 0)
    whole = rows.repartition("key").groupBy("key").agg(
        F.count("*").alias("n"), F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("raw")).alias("raw"))
    mixed = F.when(F.col("n") > 1, F.array_sort(F.arrays_zip("at", "raw")))
    return whole.withColumn("mixed", mixed).select(
        F.col("key").alias(key), F.coalesce(F.col("mixed.at"), "at").alias("at"), F.coalesce(F.col("mixed.raw"), "raw").alias("raw"))


def vectors(table: DataFrame, vocab: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, indices, values): what `case_vectors` and `tfidf` give for a written term table."""
    own = vocab.select("term", "idf").orderBy("idx").collect()      # cut to size by the fit
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    # the norm as a variable: as an expression it would be computed for every entry
    unit = F.transform(F.array(norm), lambda length: F.transform("raw", lambda x: x / length))[0]
    found = looked_up(table, [r["term"] for r in own], [r["idf"] for r in own], key)
    return found.select(key, F.col("at").alias("indices"), unit.alias("values"))


def case_vectors(weights: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, indices, values) with rising indices; a case has at most one entry per term."""
    entries = F.sort_array(F.collect_list(F.struct("idx", "weight")))
    return weights.groupBy(key).agg(entries.alias("e")).select(
        key, F.col("e.idx").alias("indices"), F.col("e.weight").alias("values"))
