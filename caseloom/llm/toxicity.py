"""Toxic passages: maximum-scoring segments of token log-odds."""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import features
from caseloom.llm.tables import in_fit, label_sample, narrow

EULER = 0.5772156649


@dataclass(frozen=True)
class Settings:
    """`buckets` of hashed words. `prior`: tokens of prior evidence (a
    twentieth of the corpus at most), spread as in the whole corpus. `sure`: log-odds
    are drawn towards 0 by so many standard errors. `drift` is then taken off, so that ordinary text scores
    below 0. `e_value`: chance passages expected per
    document below which a passage is significant. `sample`: labelled rows at most for the calibration."""
    buckets: int = 1 << 17
    prior: float = 50_000.0
    sure: float = 1.0
    drift: float = 1.0
    e_value: float = 0.5
    sample: int = 20_000


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, in linear time (Ruzzo and Tompa).

    Only the places of positive scores are walked; what lies between comes from running sums."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    # neighbouring positive places make one step
    first = at[np.concatenate([[True], np.diff(at) > 1])]
    last = at[np.concatenate([np.diff(at) > 1, [True]])] + 1
    found: list[tuple[int, int, float, float]] = []   # start, end, sum before, sum with it
    back: list[int] = []                              # place of the last candidate with a lower left sum, or -1
    for start, end, low, high in zip(first.tolist(), last.tolist(), total[first].tolist(), total[last].tolist()):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = back[j]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                back.append(j)
                break
            start, low = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass(frozen=True)
class Model:
    """Token scores, the scale and offset of chance scores (extreme values), and the calibration."""
    weights: np.ndarray
    rate: float
    log_k: float
    slope: float
    offset: float
    settings: Settings

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Sum of -ln E over the significant passages, from the limit on, and those passages with their E-values."""
        base = self.log_k + np.log(max(n, 1))
        scored = [(a, b, s, float(np.exp(np.clip(base - self.rate * s, -300.0, 50.0)))) for a, b, s in segments]
        out = [p for p in scored if p[3] <= self.settings.e_value]
        return float(sum(np.log(self.settings.e_value) - np.log(p[3]) for p in out)), out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * evidence + self.offset, -30.0, 30.0)))


class Words:
    def __init__(self, buckets: int):
        self.codes = features.Numbered(lambda w: features.hashed(w, buckets))

    def __call__(self, text: str | None) -> np.ndarray:
        return self.codes.all(features.WORD.findall((text or "").lower()))


def word_counts(docs: DataFrame, labels: DataFrame, label: str, buckets: int) -> DataFrame:
    """(bucket, n, toxic_0, toxic_1, clean_0, clean_1): occurrences of hashed words in all rows, and in the
    labelled rows that may be learnt from, halved by a hash of the id. A task adds up its rows before
    anything is shuffled."""
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & in_fit())
        .groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("half", half())
    )
    kinds = ("toxic_0", "toxic_1", "clean_0", "clean_1")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = Words(buckets), np.zeros((5, buckets), dtype=np.int64)
        for batch in batches:
            row = batch["kind"].fillna(-1).astype(int)
            for text, own in zip(batch["text"], row):
                codes, n = np.unique(words(text), return_counts=True)
                total[0, codes] += n
                if own >= 0:
                    total[1 + own, codes] += n
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at, "n": total[0, at], **{k: total[1 + i, at] for i, k in enumerate(kinds)}})

    return (
        docs.select("doc_id", "text").join(narrow(ids), "doc_id", "left")
        .select("text", ((1 - F.col("label")) * 2 + F.col("half")).alias("kind"))
        .mapInPandas(count, "bucket int, n long, " + ", ".join(f"{k} long" for k in kinds))
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *kinds)])
    )


def half() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")


def log_odds(n: np.ndarray, toxic: np.ndarray, clean: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(score of each bucket, share of each bucket among clean tokens): log-odds ratio between toxic and
    clean rows with an informative Dirichlet prior from the whole corpus, shrunk by its standard error, less the drift."""
    strength = min(settings.prior, n.sum() / 20)
    prior = strength * n / max(n.sum(), 1.0) + 1e-2
    odds = lambda own: np.log((own + prior) / (own.sum() + prior.sum() - own - prior))
    ratio = odds(toxic) - odds(clean)
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    sure = np.sign(ratio) * np.maximum(np.abs(ratio) - settings.sure * error, 0.0)
    return sure - settings.drift, (clean + prior) / (clean + prior).sum()


def chance_rate(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share * exp(rate * weights)) = 1, by bisection."""
    if not (weights[share > 0] > 0).any() or (share * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda r: float((share * np.exp(np.minimum(r * weights, 500.0))).sum()) - 1.0
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if value((low + high) / 2) < 0 else (low, (low + high) / 2)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by damped Newton steps, lightly held to 0."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        curve = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(curve, design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> Model | None:
    """Token scores from counts over all rows; chance scores and calibration from a bounded sample of labelled
    rows, each scored with what the other half of the labelled rows teaches. None without labelled rows of both
    kinds in both halves. The driver sees counts of `buckets` words and a few numbers of each sampled row."""
    found = word_counts(docs, labels, label, settings.buckets).toPandas()
    column = lambda c: np.bincount(found["bucket"], weights=found[c], minlength=settings.buckets)
    n, toxic, clean = column("n"), [column("toxic_0"), column("toxic_1")], [column("clean_0"), column("clean_1")]
    if not all(x.sum() for x in (*toxic, *clean)):
        return None
    weights, share = log_odds(n, toxic[0] + toxic[1], clean[0] + clean[1], settings)
    rate = chance_rate(weights, share)
    sent = docs.sparkSession.sparkContext.broadcast([log_odds(n, toxic[1 - i], clean[1 - i], settings)[0] for i in (0, 1)])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(settings.buckets)
        for batch in batches:
            codes = [words(t) for t in batch["text"]]
            best = [segments(sent.value[i][c]) for i, c in zip(batch["half"], codes)]
            yield pd.DataFrame({"label": batch["label"], "n": [len(c) for c in codes], "scores": [[s for *_, s in b] for b in best]})

    rows = (
        label_sample(docs, labels, label, settings.sample).withColumn("half", half())
        .mapInPandas(walk, "label int, n long, scores array<double>").toPandas()
    )
    n, y = rows["n"].to_numpy(), rows["label"].to_numpy()
    top = np.array([max(s, default=0.0) for s in rows["scores"]])
    chance = (y == 0) & (n > 0)
    # the largest chance score of n tokens has its mode at ln(K n) / rate, its mean EULER / rate above
    log_k = float(np.mean(rate * top[chance] - np.log(n[chance]))) - EULER if chance.any() else 0.0
    model = Model(weights, rate, log_k, 1.0, 0.0, settings)
    x = np.array([model.evidence([(0, 0, v) for v in s], k)[0] for s, k in zip(rows["scores"], n)])
    return Model(weights, rate, log_k, *logistic(x, y.astype(np.float64)), settings)


def passages(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, passages) of every row: passages are the significant ones, each [start, end) in places
    of words with its score and E-value; score is the calibrated chance that the row is toxic.

    Null and empty texts have no passages and the score of a row without any; without a model all scores are 0.
    Repeated rows are scored alike and all stay; an E-value equal to the limit counts. Whole texts are
    walked in linear time. An empty table gives no rows. Other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, "
              "passages array<struct<start:int,end:int,score:double,e_value:double>>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        words = Words(model.settings.buckets) if model else None
        for batch in batches:
            found = [(0.0, [])] * len(batch)
            if model:
                codes = [words(t) for t in batch["text"]]
                found = [model.evidence(segments(model.weights[c]), len(c)) for c in codes]
            score = model.score(np.array([f[0] for f in found])) if model else np.zeros(len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "passages": [
                [dict(zip(("start", "end", "score", "e_value"), p)) for p in f[1]] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(run, schema)
