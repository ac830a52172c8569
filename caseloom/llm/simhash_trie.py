"""SimHash near duplicates: fingerprints linked by a self-join of a binary trie."""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from caseloom.llm.components import components
from caseloom.llm.tables import written
from caseloom.operators.skew import attach_by_key

BITS, TURNS = 64, 4
TURN = BITS // TURNS
PIECE = 65_536          # shingles whose bits are counted at once
FRONTIER = 65_536       # node pairs that are taken a step down at once
AT_ONCE = 32            # of them between the same two components


@dataclass(frozen=True)
class Settings:
    """`width`: words of a shingle. `apart`: bits in which linked fingerprints may differ, fewer than the `TURNS` blocks.
    `unit`: fingerprints below a pair of trie nodes that one task takes on; larger pairs are parted `step` bits further down."""
    width: int = 3
    apart: int = 3
    unit: int = 100_000
    step: int = 4


def fingerprint(text: bytes | None, width: int, seed: int = 42) -> int:
    """Majority of the hash bits of all shingles of a whole text, repeats included, as a signed number; 0 without words."""
    words = (text or b"").lower().split()       # bytes: only A-Z and the white space of ASCII
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1:].tolist()
    digest, on = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:at + PIECE], ends[at:at + PIECE])], dtype=">u8")
        on += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * on > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of every row."""
    @pandas_udf("bigint")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", marked(F.col("text").cast("binary")).alias("fp"))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits in which a and b agree."""
    x = a ^ b
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return BITS - np.bitwise_count(x).astype(np.int64)


def _fork(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place in each [low, high) whose bit `depth` is set; there is one on each side of it."""
    bit = np.uint64(1) << (BITS - 1 - depth).astype(np.uint64)
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        is_set = (values[np.minimum(middle, len(values) - 1)] & bit) != 0
        high = np.where(open_ & is_set, middle, high)
        low = np.where(open_ & ~is_set, middle + 1, low)
    return low


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the least place of each component."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def self_join(values: np.ndarray, pairs: np.ndarray, apart: int) -> np.ndarray:
    """Component labels (least place) of `values` when those `apart` bits apart or less are linked.

    `values` are sorted within every range; a range [low, high) is a node of the trie, and a row of `pairs` (low, high,
    other low, other high) two nodes to be searched, or one searched within. Two nodes go down together: the bits that all
    of their leaves share with each other are compared, and the pair is dropped beyond `apart` differing bits, or when one
    component holds all leaves of both; else the node that forks first is parted. A path without forks is one step. Pairs
    that part deepest go first, so a dense group is one component before its upper nodes meet."""
    label = np.arange(len(values))
    alone = np.ones(len(values), dtype=bool)            # next to each other in a node that is searched within
    own = pairs[pairs[:, 0] == pairs[:, 2]]
    alone[own[:, 1] - 1] = False
    inside = np.zeros(len(values) + 1, dtype=np.int64)
    np.add.at(inside, own[:, 0], 1)
    np.add.at(inside, own[:, 1], -1)
    near = np.flatnonzero(alone[:-1] & (np.cumsum(inside)[:-2] > 0) & (np.bitwise_count(values[1:] ^ values[:-1]) <= apart)) if len(values) > 1 else np.zeros(0, int)
    label = _joined(label, near, near + 1)
    runs = _runs(label)
    stack: list[np.ndarray] = []
    forks, live = [pairs[pairs[:, 0] != pairs[:, 2]]], own[own[:, 1] - own[:, 0] > 1]
    levels = [np.full(len(forks[0]), BITS)]
    while len(live):                    # the two sides of every fork in a node that is searched within
        low, high = live[:, 0], live[:, 1]
        depth = _shared(values[low], values[high - 1])
        middle = _fork(values, low, high, depth)
        forks.append(np.stack([low, middle, middle, high], axis=1))
        levels.append(depth)
        live = np.concatenate([np.stack([low, middle], axis=1), np.stack([middle, high], axis=1)])
        live = live[live[:, 1] - live[:, 0] > 1]
    forks, levels = np.concatenate(forks), np.concatenate(levels)
    for level in np.unique(levels):     # the deepest last, so they are searched first
        stack.append(forks[levels == level])
    while stack:
        now = stack.pop()
        if len(now) > FRONTIER:
            stack += [now[:-FRONTIER], now[-FRONTIER:]]
            continue
        a, b, c, d = now.T
        same = (label[a] == label[c]) & (runs[a] >= b) & (runs[c] >= d)
        now = now[~same]
        if len(now) > AT_ONCE:          # one link joins two components: some of the pairs between them go first
            now, later = _some(now, label)
            if len(later):
                stack.append(later)
        if not len(now):
            continue
        a, b, c, d = now.T
        fork, other = _shared(values[a], values[b - 1]), _shared(values[c], values[d - 1])
        depth = np.minimum(fork, other)
        rest = np.minimum(BITS - depth, BITS - 1).astype(np.uint64)
        differing = np.bitwise_count(np.where(depth > 0, (values[a] ^ values[c]) >> rest, np.uint64(0)))
        leaves = depth == BITS
        found = leaves & (differing <= apart)
        if found.any():
            label = _joined(label, a[found], c[found])
            runs = _runs(label)
        go = ~leaves & (differing <= apart)
        if not go.any():
            continue
        a, b, c, d, fork, other, depth = (x[go] for x in (a, b, c, d, fork, other, depth))
        first = fork <= other
        middle = _fork(values, np.where(first, a, c), np.where(first, b, d), depth)
        l, r = first, ~first
        stack.append(np.concatenate([np.stack(part, axis=1) for part in (
            (a[l], middle[l], c[l], d[l]), (middle[l], b[l], c[l], d[l]),
            (a[r], b[r], c[r], middle[r]), (a[r], b[r], middle[r], d[r]))]))
    return label


def _some(pairs: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `AT_ONCE` pairs between each two components, and the others."""
    between = label[pairs[:, 0]] * len(label) + label[pairs[:, 2]]
    order = np.argsort(between, kind="stable")
    between = between[order]
    start = np.concatenate([[0], np.flatnonzero(between[1:] != between[:-1]) + 1])
    place = np.arange(len(pairs)) - np.repeat(start, np.diff(np.append(start, len(pairs))))
    return pairs[order[place < AT_ONCE]], pairs[order[place >= AT_ONCE]]


def _runs(label: np.ndarray) -> np.ndarray:
    """For each place the end of the run of equal labels that it lies in."""
    ends = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, len(label))
    return ends[np.searchsorted(ends, np.arange(len(label)), side="right")]


UNIT = ["turn", "depth", "a", "b"]


def units(prints: DataFrame, settings: Settings) -> DataFrame:
    """(turn, depth, a, b, side, value): the fingerprints below each pair (a, b) of trie nodes, whose first `depth` bits
    are a or b. Fingerprints three bits apart agree in one of four blocks of 16 bits, so each of four tries has
    the fingerprints turned round by a block, and its pairs start at the nodes at depth 16, each with itself."""
    turns = F.explode(F.array(*[
        F.struct(F.lit(t).alias("turn"), (F.shiftleft("fp", t * TURN).bitwiseOR(F.shiftrightunsigned("fp", BITS - t * TURN)) if t else F.col("fp")).alias("value"))
        for t in range(TURNS)])).alias("t")
    node = F.shiftrightunsigned("t.value", BITS - TURN)
    live = prints.select(turns).select("t.turn", F.lit(TURN).alias("depth"), node.alias("a"), node.alias("b"), F.lit(0).alias("side"), "t.value")
    done = None
    while True:
        live = written(live)
        sizes = live.groupBy(*UNIT).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        sizes = sizes.where((F.col("a") == F.col("b")) | ((F.col("n0") > 0) & (F.col("n1") > 0))).where("n0 + n1 > 1")
        large = written(sizes.where((F.col("n0") + F.col("n1") > settings.unit) & (F.col("depth") + settings.step <= BITS - settings.step)).select(*UNIT))
        if large.isEmpty():
            return live if done is None else done.unionByName(live)
        small = live.join(large, UNIT, "left_anti")
        done = small if done is None else done.unionByName(small)
        live = _parted(live.join(large, UNIT), settings)


def _parted(rows: DataFrame, settings: Settings) -> DataFrame:
    """The rows of each pair of nodes, given to the pairs of their children within the error budget."""
    down = F.col("depth") + settings.step
    own = F.call_function("shiftrightunsigned", F.col("value"), F.lit(BITS) - down)
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    masks = F.filter(F.array(*[F.lit(m).cast("long") for m in range(1 << settings.step)]), lambda m: F.bit_count(m) + spent <= settings.apart)
    child = own.bitwiseAND(F.lit((1 << settings.step) - 1))
    above = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    rows = rows.select("turn", "depth", "a", "b", "side", "value", F.explode(masks).alias("m"))
    partner = F.shiftleft(above, settings.step).bitwiseOR(child.bitwiseXOR(F.col("m")))
    within = F.col("a") == F.col("b")
    side = F.when(within, (own > partner).cast("int")).otherwise(F.col("side"))
    rows = rows.select("turn", down.alias("depth"), own.alias("own"), partner.alias("partner"), side.alias("side"), "value")
    first = F.col("side") == 0
    return rows.select("turn", "depth", F.when(first, F.col("own")).otherwise(F.col("partner")).alias("a"),
                       F.when(first, F.col("partner")).otherwise(F.col("own")).alias("b"), "side", "value")


def links(prints: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, at most one fewer than the fingerprints of a unit, that connect what is linked."""
    if not 0 <= settings.apart < TURNS:
        raise ValueError("Fingerprints may differ in fewer bits than there are blocks")
    placed = units(prints, settings)
    key = [*UNIT, "side"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < settings.unit:
                continue
            rows = pd.concat(held)
            last = (rows[UNIT] == rows[UNIT].iloc[-1]).all(axis=1).to_numpy()     # may go on in the next batch
            held, size = [rows[last]], int(last.sum())
            if not last.all():
                yield linked(rows[~last])
        if size:
            yield linked(pd.concat(held))

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["value"].to_numpy().astype(np.int64).view(np.uint64)
        numbers = rows[key].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]).any(axis=1)]))
        end = np.append(start[1:], len(rows))
        a, b, side = numbers[start, 2], numbers[start, 3], numbers[start, 4]
        own = a == b
        follows = np.append((numbers[start[1:], :4] == numbers[start[:-1], :4]).all(axis=1), False)
        two = np.flatnonzero((side == 0) & ~own & follows)
        pairs = np.concatenate([np.stack([start[own], end[own], start[own], end[own]], axis=1),
                                np.stack([start[two], end[two], start[two + 1], end[two + 1]], axis=1)])
        label = self_join(values, pairs, settings.apart)
        at = np.flatnonzero(label != np.arange(len(label)))
        turn = rows["turn"].to_numpy()
        back = lambda i: _turned_back(values[i], turn[i])
        return pd.DataFrame({"a": back(label[at]), "b": back(at)})

    sorted_ = placed.repartition(*UNIT).sortWithinPartitions(*key, "value")
    return written(sorted_.mapInPandas(search, "a bigint, b bigint"))


def _turned_back(values: np.ndarray, turn: np.ndarray) -> np.ndarray:
    by = (turn * TURN).astype(np.uint64)
    turned = (values >> by) | (values << ((np.uint64(BITS) - by) % np.uint64(BITS)))
    return np.where(by == 0, values, turned).view(np.int64)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the smallest doc_id that links reach.

    Equal fingerprints are one leaf of the tries, however many rows have them, and a node pair whose leaves are connected
    already isn't searched, so neither a group of copies nor one of near copies is met pair by pair.

    Null and empty texts have the fingerprint 0 and are linked like any other; very long texts count whole. Rows without an id
    take part and get the component's id, null if no row of it has one. Equal ids and repeated rows each give a row. An empty
    table gives no rows. Other columns are not read."""
    rows = written(fingerprints(docs, settings.width))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    roots = components(links(prints.select("fp"), settings))
    named = written(prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "rows", F.coalesce("root", "fp").alias("root")))
    groups = written(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    ids = written(attach_by_key(named, groups, "root", "members", "fp").select("fp", "component_id", "rows"))
    placed = attach_by_key(rows.withColumn("at", F.monotonically_increasing_id()), ids, "fp", "rows", "at")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
