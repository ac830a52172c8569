"""Shards by minimax contiguous partition (DataFrame functions only)."""
import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.llm.tables import written

STEP_BITS = 12
SLOT_CELLS = 16384


def group_key(text: str = "text") -> Column:
    """Place of a text in the order of groups: a whole number from 0 to 2**63 - 1, equal for equal texts."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1)


def cells_used(sizes: np.ndarray, capacity: int, first: int = 0) -> list[int]:
    """Ends of the runs that a greedy walk makes, each as full as `capacity` allows."""
    total, ends, at = np.cumsum(sizes), [], first
    while at < len(sizes):
        before = total[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(total, before + capacity, side="right")))
        ends.append(at)
    return ends


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Least capacity with which the greedy walk needs `shards` runs at most, by binary search."""
    low = max(int(sizes.max()), -(-int(sizes.sum()) // shards))
    high = low + int(sizes.max())
    while low < high:
        middle = (low + high) // 2
        if len(cells_used(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cut_places(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Index of the first cell of shards 1, 2, ...: of the cuts that `capacity` allows, each the one
    closest to an even share of what is left, so that no shard stays empty beside a large group."""
    total, cuts, at = np.cumsum(sizes), [], 0
    for left in range(shards, 1, -1):
        before = int(total[at - 1]) if at else 0
        share = (int(total[-1]) - before) / left
        end = int(np.searchsorted(total, before + share, side="left"))
        over = end < len(sizes) and total[end] - before <= capacity and total[end] - before - share < share - (total[end - 1] - before if end > at else 0)
        end = min(len(sizes), max(at + (at < len(sizes)), end + bool(over)))
        while end < len(sizes) and len(cells_used(sizes, capacity, end)) > left - 1:
            end += 1
        cuts.append(end)
        at = end
    return cuts


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(smallest key of shards 1, 2, ..., capacity) over `groups` (key, size), one row per group.

    The driver sees cells of neighbouring keys, first 2**12 of them; those in which a cut can fall
    are parted into 2**12 again until each is a single group. At most a few thousand cells for each
    cut, however many groups there are."""
    def cells(where: Column, shift: int) -> list[tuple[int, int, int, int]]:
        at = F.shiftleft(F.shiftright("key", shift), shift)
        return [tuple(r) for r in groups.where(where).groupBy(at.alias("low")).agg(
            F.sum("size").cast("long"), F.count("*"), F.max("key")).collect()]

    shift = 63 - STEP_BITS
    known = sorted((low, size, n, top, shift) for low, size, n, top in cells(F.lit(True), shift))
    if not known:
        return [], 0
    while True:
        sizes = np.array([c[1] for c in known], dtype=np.int64)
        capacity = smallest_capacity(sizes, shards)
        # with divisible cells no capacity below the even share does; every cut lies between the two walks
        least = max(-(-int(sizes.sum()) // shards), max((c[1] for c in known if c[2] == 1), default=0))
        total = np.cumsum(sizes)
        near = set()
        for end in (*cut_places(sizes, shards, capacity), *cells_used(sizes, capacity), *cells_used(sizes, least)):
            near.update((end - 1, end))
        for j in range(1, shards):
            near.add(int(np.searchsorted(total, total[-1] * j / shards)))
        near = {i for i in near if 0 <= i < len(known) and known[i][2] > 1 and known[i][4] > 0}
        if not near:
            # as the law is near-equal bytes, groups of one shard stay neighbours in key order
            return [known[i][0] if i < len(known) else 2**63 - 1 for i in cut_places(sizes, shards, capacity)], capacity
        finer = []
        for by in {known[i][4] for i in near}:
            parts = [i for i in near if known[i][4] == by]
            inside = F.lit(False)
            for i in parts:
                inside = inside | F.col("key").between(known[i][0], known[i][3])
            to = max(0, by - STEP_BITS)
            finer += [(low, size, n, top, to) for low, size, n, top in cells(inside, to)]
        known = sorted([c for i, c in enumerate(known) if i not in near] + finer)


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, law `bytes`.

    Rows with equal texts are one group and share a shard; groups stand in the order of a hash, and
    shards are runs of groups, of the smallest possible largest size. A group larger than an even
    share keeps a shard of its own size; the cuts then even out the rest.
    Null and empty texts are one group of size 1 a row. Repeated rows each get a slot. An empty table
    gives no rows. Other columns of `docs` are not read."""
    rows = written(docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        group_key().alias("key"),
    ).select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "key"))
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")))
    keys, _ = cut_keys(groups, count)
    shard = F.lit(0)
    for key in keys:
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
                         F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_CELLS)).cast("int").alias("_cell"))
    # slots: rows are numbered inside small cells by a hash of the id, so that no task sees a whole shard
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cell = Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_place", F.row_number().over(cell))
        .join(offsets.hint("merge"), ["shard", "_cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("_before") + F.col("_place") - 1).alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"))
    )
