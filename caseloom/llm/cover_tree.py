"""Hard negatives by inner product: cover trees over norm-augmented vectors, searched best first."""
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.llm.tables import written

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """`positives`, `negatives`: rows per anchor and per positive. `low`, `high`: window of a negative's score in percent of
    the positive's. `leaf`: rows of a node that are verified at once. `shrink`: covering radius of a level, of the one above.
    `block`: anchors that are sent to the tasks at once; each block is two scans. `sample`: rows that `cells` centres are chosen from."""
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    leaf: int = 256
    shrink: float = 0.85
    block: int = 8192
    sample: int = 2048
    cells: int = 64


def matrix(vectors, width: int = 0) -> np.ndarray:
    """Whole-number vectors as rows; shorter ones end in zeros."""
    width = max([width, *map(len, vectors)], default=width)
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v) for v in vectors], dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, as whole numbers: by floats where every sum is below 2 ** 53."""
    top = lambda x: int(max(x.max(initial=0), -x.min(initial=0)))
    if top(a) * top(b) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class CoverTree:
    """Points are augmented to one norm, so inner products fall as distances grow. A node holds points within `radius` of
    its centre; the centres below it are so many that its points are within `shrink` times that of one. The node's own
    centre is the first of them, the point farthest from all others the next."""

    def __init__(self, points: np.ndarray, leaf: int, shrink: float):
        self.points = points
        real = points.astype(float)
        squares = (real * real).sum(axis=1)
        self.top = float(squares.max(initial=0.0))
        self.augmented = np.column_stack([real, np.sqrt(np.maximum(self.top - squares, 0.0))])
        self.order = np.arange(len(points))
        reach = self.apart(self.order, 0)
        self.nodes = [(0, len(points), 0, float(reach.max(initial=0.0)))]     # low, high, centre, radius
        self.below: dict[int, range] = {}
        open_ = [0]
        while open_:
            at = open_.pop()
            low, high, _, radius = self.nodes[at]
            if high - low > leaf and radius > 0:
                self.part(at, shrink * radius)
                open_ += self.below[at]

    def apart(self, rows: np.ndarray, centre: int) -> np.ndarray:
        step = self.augmented[rows] - self.augmented[centre]
        return np.sqrt(np.einsum("ij,ij->i", step, step))

    def part(self, at: int, radius: float) -> None:
        low, high, centre, _ = self.nodes[at]
        rows = self.order[low:high]
        centres, owner, near = [centre], np.zeros(len(rows), dtype=np.int64), self.apart(rows, centre)
        while near.max() > radius:
            new = int(near.argmax())
            centres.append(int(rows[new]))
            reach = self.apart(rows, centres[-1])
            closer = reach < near
            closer[new] = True
            owner[closer] = len(centres) - 1
            near = np.minimum(near, reach)
        sort = np.argsort(owner, kind="stable")
        self.order[low:high] = rows[sort]
        ends = np.searchsorted(owner[sort], np.arange(len(centres) + 1))
        first = len(self.nodes)
        for k, c in enumerate(centres):
            if ends[k] < ends[k + 1]:
                self.nodes.append((low + int(ends[k]), low + int(ends[k + 1]), c, float(near[sort][ends[k]:ends[k + 1]].max())))
        self.below[at] = range(first, len(self.nodes))

    def bounds(self, queries: np.ndarray, lengths: np.ndarray, nodes: range) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any point of each node."""
        centres = np.array([self.nodes[k][2] for k in nodes])
        radius = np.array([self.nodes[k][3] for k in nodes])
        score = queries @ self.points[centres].T.astype(float)
        both = (lengths * lengths)[:, None] + self.top
        away = np.sqrt(np.maximum(both - 2 * score, 0.0))
        slack = 1e-7 * (both + 1.0)
        step = lengths[:, None] * radius
        high = np.minimum((both - np.maximum(away - radius, 0.0) ** 2) / 2, score + step) + slack
        low = np.maximum((both - (away + radius) ** 2) / 2, score - step) - slack
        return low, high


class Best:
    """The `k` best (score, id) of every query window, the highest score and then the smallest id first."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.queries, self.ids, self.labels, self.low, self.high, self.same, self.k = queries, ids, labels, low, high, same, k
        self.real = queries.astype(float)
        self.lengths = np.sqrt((self.real * self.real).sum(axis=1))
        self.score = np.full((*low.shape, k), LOWEST)
        self.id = np.full((*low.shape, k), HIGHEST)
        self.seen = 0

    def wanted(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Queries of `rows` with a window that scores between `low` and `high` can still enter."""
        least = np.maximum(self.low[rows], self.score[rows, :, -1])
        return ((high[:, None] >= least) & (low[:, None] <= self.high[rows]) & (self.low[rows] <= self.high[rows])).any(axis=1)

    def search(self, tree: CoverTree, ids: np.ndarray, labels: np.ndarray) -> None:
        """Nodes by falling bound; a node that no window of any query can use is skipped, leaves are scored exactly."""
        everyone = np.arange(len(self.queries))
        low, high = tree.bounds(self.real, self.lengths, range(1))
        queue, pushed = [(-float(high.max(initial=0)), 0, 0, everyone, low[:, 0], high[:, 0])], 0
        while queue:
            _, _, at, rows, low, high = heapq.heappop(queue)
            keep = self.wanted(low, high, rows)
            rows = rows[keep]
            if not len(rows):
                continue
            below = tree.below.get(at)
            if below is None:
                start, end = tree.nodes[at][:2]
                for s in range(start, end, 1024):
                    own = tree.order[s:min(s + 1024, end)]
                    self.verify(rows, tree.points[own], ids[own], labels[own])
                continue
            low, high = tree.bounds(self.real[rows], self.lengths[rows], below)
            for j, node in enumerate(below):
                some = self.wanted(low[:, j], high[:, j], rows)
                if some.any():
                    pushed += 1
                    heapq.heappush(queue, (-float(high[some, j].max()), pushed, node, rows[some], low[some, j], high[some, j]))

    def verify(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.seen += len(rows) * len(points)
        scores = exact(self.queries[rows], points)
        fits = (self.ids[rows][:, None] != ids) & ((self.labels[rows][:, None] == labels) == self.same)
        for w in range(self.low.shape[1]):
            least = np.maximum(self.low[rows, w], self.score[rows, w, -1])
            found = fits & (scores >= least[:, None]) & (scores <= self.high[rows, w][:, None])
            if found.shape[1] > self.k and len(np.unique(ids)) == len(ids):      # at most the k best and their equals
                kept = np.where(found, scores, LOWEST)
                found &= kept >= -np.partition(-np.maximum(kept, LOWEST + 1), self.k - 1, axis=1)[:, self.k - 1:self.k]
            at, point = np.nonzero(found)
            if len(at):
                self.enter(rows[at], w, scores[at, point], ids[point])

    def enter(self, rows: np.ndarray, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(touched, self.k)])
        scores = np.concatenate([scores, self.score[touched, w].ravel()])
        ids = np.concatenate([ids, self.id[touched, w].ravel()])
        order = np.lexsort((ids, -np.maximum(scores, LOWEST + 1), rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        again = np.zeros(len(rows), dtype=bool)       # repeated rows count once
        again[1:] = (rows[1:] == rows[:-1]) & (scores[1:] == scores[:-1]) & (ids[1:] == ids[:-1]) & (scores[1:] != LOWEST)
        rows, scores, ids = rows[~again], scores[~again], ids[~again]
        start = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        first = place < self.k
        self.score[rows[first], w, place[first]] = scores[first]
        self.id[rows[first], w, place[first]] = ids[first]

    def rows(self) -> pd.DataFrame:
        query, window, place = np.nonzero(self.score != LOWEST)
        return pd.DataFrame({"query": query, "window": window, "score": self.score[query, window, place], "id": self.id[query, window, place]})


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): components x as floor(scale * x), of rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def placed(rows: DataFrame, settings: Settings) -> DataFrame:
    """`rows`, like vectors next to each other: sorted by range of the nearest of some centres and a hash, so a centre with a
    third of all rows is spread. Centres are the farthest from each other in a sample of `sample` rows; any centres give the same results."""
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(settings.sample).select("vector").toPandas()["vector"]
    tree = CoverTree(matrix(list(sample)), settings.sample, settings.shrink) if len(sample) else None
    chosen: list[int] = [0]
    if tree is not None:
        near = tree.apart(tree.order, 0)
        while len(chosen) < settings.cells and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, tree.apart(tree.order, chosen[-1]))
    centres = tree.points[chosen] if tree is not None else np.zeros((1, 1), dtype=np.int64)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        points = matrix(list(vectors), centres.shape[1]).astype(float)
        own = np.zeros((len(centres), points.shape[1]))
        own[:, :centres.shape[1]] = centres
        return pd.Series(((own * own).sum(axis=1) - 2 * points @ own.T).argmin(axis=1), dtype="int32")

    celled = rows.withColumn("cell", nearest("vector")).withColumn("mix", F.xxhash64("vec_id", "vector"))
    return written(celled.repartitionByRange("cell", "mix").sortWithinPartitions("cell", "mix").drop("cell", "mix"))


def searched(rows: DataFrame, anchors: pd.DataFrame, low: np.ndarray, high: np.ndarray, same: bool, k: int, settings: Settings) -> DataFrame:
    """(query, window, score, id, rank): the `k` best rows for each window [low, high] of each anchor, by its place in `anchors`.

    Every task builds a tree of each batch that it reads and keeps the best rows so far, which bound its next
    searches; it sends back k rows for each window at most."""
    queries = matrix(anchors["vector"].tolist())
    shared = rows.sparkSession.sparkContext.broadcast((queries, anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), low, high))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if not len(batch):
                continue
            points = matrix(batch["vector"].tolist(), queries_width)
            if best is None or points.shape[1] > best.queries.shape[1]:
                old, (own, *others) = best, shared.value
                best = Best(matrix(list(own), points.shape[1]), *others, same, k)
                if old is not None:
                    best.score, best.id = old.score, old.id
            points = points if points.shape[1] == best.queries.shape[1] else matrix(list(points), best.queries.shape[1])
            best.search(CoverTree(points, settings.leaf, settings.shrink), batch["vec_id"].to_numpy(), batch["label"].to_numpy())
        if best is not None:
            yield best.rows()

    queries_width = queries.shape[1]
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    parts = rows.select("vec_id", "label", "vector").mapInPandas(run, "query int, window int, score bigint, id bigint").distinct()
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `rows` (vec_id, label, vector), vectors
    of whole numbers: for each anchor its best other rows of the same label, and for each of those the best rows of other labels
    whose score lies between `low` and `high` percent of the positive's. Scores are exact (64 bits); ties go to the smaller vec_id.

    Anchors go to the tasks in blocks; rows stay where they are. Repeated rows count once; rows that share an id are never each
    other's positive or negative, and each of them is an anchor of its own. A vector that is shorter than another ends in
    zeros. Positives with a negative score have an empty window. An empty table, or one without anchors, gives no rows."""
    rows = placed(rows.select("vec_id", F.col("label").cast("long").alias("label"), "vector"), settings)
    found = None
    for anchors in _blocks(rows.where(is_anchor).distinct(), settings.block):
        n, k = len(anchors), settings.positives
        open_ = np.full((n, 1), LOWEST + 1), np.full((n, 1), HIGHEST)
        best = written(searched(rows, anchors, *open_, True, k, settings))
        own = best.toPandas()                                  # positives of a block: bounded by its size
        scores = np.full((n, k), -1, dtype=np.int64)
        scores[own["query"], own["rank"] - 1] = own["score"]
        hundreds, rest = np.divmod(scores, 100)               # 80 * score could leave 64 bits
        low = np.where(scores < 0, 1, settings.low * hundreds - (-settings.low * rest // 100))
        high = np.where(scores < 0, 0, settings.high * hundreds + settings.high * rest // 100)
        names = rows.sparkSession.createDataFrame(pd.DataFrame({"query": np.arange(n, dtype=np.int32), "anchor_id": anchors["vec_id"].astype("int64")}))
        negatives = searched(rows, anchors, low, high, False, settings.negatives, settings).select(
            "query", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        positives = best.select("query", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        block = written(negatives.join(positives, ["query", "place"]).join(F.broadcast(names), "query").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        found = block if found is None else found.unionByName(block)
    return rows.sparkSession.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if found is None else found


def _blocks(anchors: DataFrame, limit: int) -> Iterator[pd.DataFrame]:
    """The anchors, `limit` at a time; the driver holds one block and one partition."""
    held = []
    for row in written(anchors).toLocalIterator():
        held.append((row["vec_id"], row["label"], row["vector"]))
        if len(held) == limit:
            yield pd.DataFrame(held, columns=["vec_id", "label", "vector"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["vec_id", "label", "vector"])
