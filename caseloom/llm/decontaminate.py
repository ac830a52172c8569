"""Benchmark windows found in training texts."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import let

WINDOW = 10
# The items go to the executors in blocks of so many characters; each block is one scan.
BLOCK_CHARS = 16_000_000
# Word characters are 0-9, a-z and all beyond ASCII; A-Z count as a-z.
_AS_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_AS_WORD).split()


class Windows:
    """Hash set of the windows of a block of items: for each length the sorted hashes of the windows
    and where each stands in the numbered words of all items."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        self.numbers: dict[bytes, int] = {}
        words, starts, owners = [], {}, []
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            length = min(width, len(own))
            if length:
                starts.setdefault(length, []).extend(range(len(words), len(words) + len(own) - length + 1))
                words += own
                owners += [item] * len(own)
        self.words, self.owners = np.array(words, dtype=np.uint64), owners
        self.windows = []
        for length, at in sorted(starts.items()):
            at = np.array(at, dtype=np.int64)
            mixed = self.mixed([self.words[at + j] for j in range(length)])
            order = np.argsort(mixed, kind="stable")
            self.windows.append((length, mixed[order], at[order]))

    @staticmethod
    def mixed(columns: list[np.ndarray]) -> np.ndarray:
        """One hash per window from its word numbers, given place by place."""
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list]:
        """(words, spans of word places inside a window, items). Hash hits are compared word by word."""
        words = words_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        covered, items = np.zeros(len(ids) + 1, dtype=np.int64), set()
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, hashes, places in self.windows:
            n = len(ids) - length + 1
            if n < 1:
                continue
            # a window can only lie where every word is one that the items use
            starts = np.flatnonzero(unknown[length:] == unknown[:n])
            mixed = self.mixed([ids[starts + j] for j in range(length)])
            low, high = np.searchsorted(hashes, mixed), np.searchsorted(hashes, mixed, side="right")
            for k in np.flatnonzero(low < high).tolist():
                i = int(starts[k])
                for place in places[low[k]:high[k]].tolist():
                    if np.array_equal(self.words[place:place + length], ids[i:i + length]):
                        covered[i] += 1
                        covered[i + length] -= 1
                        items.add(self.owners[place])
        inside = np.concatenate([[0], np.cumsum(covered)[:-1] > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        return len(words), list(zip(edges[::2].tolist(), edges[1::2].tolist())), sorted(items)


def blocks(benchmark: DataFrame, limit: int) -> list[list[tuple[object, str]]]:
    """The items in lists of `limit` characters at most (or one longer item)."""
    out, size = [], limit + 1
    for item, text in benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator():
        if size + len(text) > limit:
            out.append([])
            size = 0
        out[-1].append((item, text))
        size += len(text)
    return out


def _runs(places: Column) -> Column:
    """[start, end) runs of sorted places."""
    def runs(at: Column) -> Column:
        first = F.filter(at, lambda p, i: (i == 0) | (at[i - 1] != p - 1))
        last = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    return let(places, runs)


def _row_hits(docs: DataFrame, benchmark: DataFrame, width: int, block_chars: int) -> DataFrame:
    """`hits`, and `_row`, xxhash64(doc_id, text)."""
    kinds = {"id": docs.schema["doc_id"].dataType.simpleString(), "item": benchmark.schema["item_id"].dataType.simpleString()}
    schema = "doc_id {id}, _row bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<{item}>".format(**kinds)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    parts = []
    for items in blocks(benchmark, block_chars) or [[]]:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            windows = Windows(sent.value, width)
            for batch in batches:
                found = [windows.scan(t) for t in batch["text"]]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"], "_row": batch["_row"], "n_words": [f[0] for f in found],
                    "spans": [[{"start": a, "end": b} for a, b in f[1]] for f in found],
                    "items": [f[2] for f in found],
                })

        parts.append(rows.mapInPandas(scan, schema))
    if len(parts) == 1:
        return parts[0]
    whole = parts[0].withColumn("_copies", F.lit(1))
    for part in parts[1:]:
        whole = whole.unionByName(part.withColumn("_copies", F.lit(0)))
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    # rows with the same id and text have the same hits; each comes back as often as it stands in `docs`
    merged = whole.groupBy("doc_id", "_row", "n_words").agg(
        F.sum("_copies").cast("int").alias("_copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(places)))).alias("_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(
        "doc_id", "_row", "n_words", _runs(F.col("_at")).alias("spans"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: spans are the [start, end) runs of word places inside
    an occurrence of an item's window; items are the sorted ids of the items with a window there.

    An item of fewer than `width` words is one window; null items and items without words have none.
    Null and empty texts have no words and no hits. Repeated rows are judged alike and all stay; items
    with the same window are all named. An empty table gives no rows, an empty benchmark no hits.
    Other columns are not read.

    The items are sent to every executor, `block_chars` characters at most at a time. A larger
    benchmark is scanned for block by block and the hits of a row are put together."""
    return _row_hits(docs, benchmark, width, block_chars).drop("_row")


def n_hit() -> Column:
    """Words inside a hit."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window of an item. Rows are judged by id and text, so rows
    that share an id, and rows without one, get the verdict of their own text."""
    bad = _row_hits(docs, benchmark, width, BLOCK_CHARS).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_doc"), F.col("_row").alias("_bad")).distinct()
    return docs.join(bad, (F.xxhash64("doc_id", "text") == F.col("_bad")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
