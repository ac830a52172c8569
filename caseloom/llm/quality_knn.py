"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from caseloom.llm import features
from caseloom.llm.tables import label_sample

WORDS, SHAPES = 4096, 512
BLOCK = 256
# Rows with a lower score are judged bad.
REJECT_BELOW = 0.3


@dataclass(frozen=True)
class Settings:
    """`sample`: labelled rows that the vectors are fitted on and that vote, at most. `dims`: latent
    dimensions. `neighbours`: rows that vote (more where the last ones tie). `power` of the similarity as weight."""
    sample: int = 4000
    dims: int = 64
    neighbours: int = 25
    power: float = 4.0
    seed: int = 5


class Terms:
    """Term counts of whole texts: words hashed to WORDS places, pairs of token shapes to SHAPES places."""

    def __init__(self):
        self.codes = features.Numbered(lambda t: features.hashed(t.lower(), WORDS) * 64 + features.shape(t))

    def counts(self, text: str | None) -> np.ndarray:
        codes = self.codes.all(features.TOKEN.findall(text or ""))
        out = np.zeros(WORDS + SHAPES, dtype=np.float32)
        if len(codes):
            words, shapes = codes >> 6, codes & 63
            same = np.concatenate([[False], words[1:] == words[:-1]])
            shapes = np.where(same, 0, shapes)
            pairs = (np.concatenate([[63], shapes[:-1]]) * 67 + shapes) % SHAPES
            out[:WORDS] = np.bincount(words, minlength=WORDS)
            out[WORDS:] = np.bincount(pairs, minlength=SHAPES)
        return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf rows; words and shapes each have length 1."""
    x = np.log1p(counts) * idf
    for part in (slice(0, WORDS), slice(WORDS, None)):
        x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def latent(x: np.ndarray, settings: Settings) -> np.ndarray:
    """Right singular vectors of the largest singular values, by a seeded randomised range finder."""
    k = min(settings.dims, *x.shape)
    q = np.random.default_rng(settings.seed).standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :k].astype(np.float32)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    settings: Settings

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Vote of the nearest labelled vectors, by exact cosine products with all of them."""
        prior = float(self.labels.mean())
        similar = unit(weighted(counts, self.idf) @ self.axes) @ self.vectors.T
        k = min(self.settings.neighbours, similar.shape[1])
        least = np.partition(similar, similar.shape[1] - k, axis=1)[:, similar.shape[1] - k]
        weight = np.where(similar >= least[:, None], np.maximum(similar, 0.0), 0.0).astype(np.float64) ** self.settings.power
        total = weight.sum(axis=1)
        return np.where(total > 1e-12, (weight @ self.labels) / np.maximum(total, 1e-12), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> Model | None:
    """Latent vectors of a bounded sample of labelled rows; texts are counted in the tasks. None without labelled rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            rows = [terms.counts(t) for t in batch["text"]]
            at = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": [a.tobytes() for a in at],
                                "n": [r[a].tobytes() for r, a in zip(rows, at)]})

    # the driver holds one table of the sample's terms: bytes come, and weights take the places of the counts
    found = (
        label_sample(docs, labels, label, settings.sample)
        .mapInPandas(count, "doc_id long, label int, at binary, n binary").toPandas()
        .drop_duplicates("doc_id").sort_values("doc_id")
    )
    if not len(found):
        return None
    x, holding = np.zeros((len(found), WORDS + SHAPES), dtype=np.float32), np.zeros(WORDS + SHAPES, dtype=np.int64)
    for i, (at, n) in enumerate(zip(found["at"], found["n"])):
        at = np.frombuffer(at, dtype=np.int32)
        x[i, at] = np.frombuffer(n, dtype=np.float32)
        holding[at] += 1
    idf = np.log((1 + len(found)) / (1 + holding)).astype(np.float32) + np.float32(0.1)
    for start in range(0, len(x), BLOCK):
        x[start:start + BLOCK] = weighted(x[start:start + BLOCK], idf)
    axes = latent(x, settings)
    return Model(idf, axes, unit(x @ axes), found["label"].to_numpy(dtype=np.float64), settings)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row: the similarity-weighted share of label 1 among its nearest labelled rows.

    Null and empty texts, and texts that resemble no labelled row, get the share of label 1 in the
    sample; without a model every row gets 0.5. Repeated rows are scored alike and all stay; neighbours that tie with the last
    one vote too. An empty table gives no rows. Other columns are not read. The model is broadcast; its
    size is bounded by `sample` and `dims`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, model = Terms(), sent.value
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start:start + BLOCK]
                score = np.full(len(part), 0.5) if model is None else model.score(np.stack([terms.counts(t) for t in part["text"]]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": np.clip(score, 0.0, 1.0)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
