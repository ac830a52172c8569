"""Packing of examples into sequences: vector bin packing by a dot-product heuristic."""
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

END = 1
# Texts encoded together.
TOGETHER = 1024
# Words encoded as one text, and the character between them.
RUN, MARK = 1000, "\x01"
# str.split() parts at these, the tokenizer doesn't
_SEPARATORS = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Limits:
    """Of one sequence: `tokens`, `segments` (pieces) and `loss` (tokens that bear loss). A sequence
    with `slack` free tokens or fewer is closed; with more, an example is cut to fill it. At most
    `window` examples wait at a time in a task."""
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    slack: int = 4
    window: int = 512


class Tokens:
    """Ids of whole texts. The tokenizer drops white space and joins nothing across it, so a word is
    encoded once and looked up after that; `words` of them are remembered at most, by all tasks that a
    Python worker runs. Of these, words not met again since half as many others came are forgotten first. Words not yet
    known are encoded together, with a mark between them."""

    shared: dict[str, "Tokens"] = {}

    def __init__(self, path: str, words: int = 1_000_000, longest: int = 64):
        # Spark runs a task on each core, so threads of the tokenizer's own would only wait for one another
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.longest = Tokenizer.from_file(path), words, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words without MARK, a thousand as one text."""
        texts = [f" {MARK} ".join(words[i:i + RUN]) + f" {MARK}" for i in range(0, len(words), RUN)]
        ids = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, dtype="<u4")
        raw, out, start = ids.tobytes(), [], 0
        for end in (np.flatnonzero(ids == self.mark) * 4).tolist():
            out.append(raw[start:end])
            start = end + 4
        return out

    def learn(self, new: list[str]) -> None:
        plain = [w for w in new if MARK not in w] if self.mark is not None else []
        found = self.together(plain)
        if len(found) == len(plain):
            self.known.update(zip(plain, found))
            new = [w for w in new if MARK in w] if plain else new
        self.known.update(zip(new, self.alone(new)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.words // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        parts = [[t] if _SEPARATORS.search(t) else t.split() for t in texts]
        new = set().union(*parts).difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        new = list(new - again)
        self.learn(new)
        get = known.__getitem__
        out = [b"".join(map(get, own)) for own in parts]
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out


class Packer:
    """Pieces from a stream of examples (key, ids, number of leading ids that bear no loss).

    One sequence is open. Of the waiting examples that fit whole, the one whose demand (tokens,
    segments, loss, as shares of the limits) has the largest dot product with what is left goes in
    next; when none fits, the longest is cut to fill the sequence. Whole sequences of an
    example longer than one are cut off when it comes."""

    def __init__(self, limits: Limits, first: int):
        self.limits, self.next = limits, first
        self.full = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.waiting: list[tuple] = []                   # key, whole ids, start, quiet
        self.demand = np.zeros((3, limits.window + 1))
        self.open()

    def open(self) -> None:
        self.room, self.offset, self.sequence = self.full.copy(), 0, self.next
        self.next += 1

    def needs(self, example: tuple, length: int | None = None) -> tuple[int, int, int]:
        key, ids, start, quiet = example
        length = len(ids) - start if length is None else length
        return length, 1, start + length - max(start, min(quiet, start + length))

    def cut(self, example: tuple, room: np.ndarray) -> int:
        """Most tokens of the example that `room` holds."""
        key, ids, start, quiet = example
        return int(min(len(ids) - start, room[0], max(0, quiet - start) + room[2]))

    def piece(self, example: tuple, length: int, sequence: int, offset: int) -> tuple:
        key, ids, start, quiet = example
        return key, start, length, len(ids), self.needs(example, length)[2], sequence, offset, ids[start:start + length].tobytes()

    def add(self, key, ids: np.ndarray, quiet: int = 0) -> Iterator[tuple]:
        example = (key, ids, 0, quiet)
        while len(ids) - example[2] >= self.limits.tokens and (length := self.cut(example, self.full)):
            yield self.piece(example, length, self.next, 0)
            self.next += 1
            example = (key, ids, example[2] + length, quiet)
        if example[2] < len(ids):
            self.demand[:, len(self.waiting)] = self.needs(example)
            self.waiting.append(example)
        while len(self.waiting) >= self.limits.window:
            yield self.step()

    def step(self) -> tuple:
        n = len(self.waiting)
        if self.offset and (self.room[0] <= self.limits.slack or self.room[1] < 1):
            self.open()
        (tokens, segments, loss), room = self.demand[:, :n], self.room
        fits = (tokens <= room[0]) & (segments <= room[1]) & (loss <= room[2])
        worth = (room / self.full / self.full) @ self.demand[:, :n]
        worth[~fits] = -1.0
        i = int(worth.argmax())
        if fits[i]:
            length = int(tokens[i])
        else:
            i = int(tokens.argmax())
            length = self.cut(self.waiting[i], self.room)
            if length < 1:  # no room for loss
                self.open()
                return self.step()
        key, ids, start, quiet = example = self.waiting[i]
        out = self.piece(example, length, self.sequence, self.offset)
        self.room -= self.needs(example, length)
        self.offset += length
        if start + length < len(ids):
            self.waiting[i] = (key, ids, start + length, quiet)
            self.demand[:, i] = self.needs(self.waiting[i])
        else:
            self.waiting[i], self.demand[:, i] = self.waiting[-1], self.demand[:, n - 1]
            self.waiting.pop()
        return out

    def rest(self) -> Iterator[tuple]:
        while self.waiting:
            yield self.step()


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids) of every piece.

    An example is the ids of `text` and END; ids of the column `prompt`, if named, come before and bear
    no loss. `ids` holds a piece as little-endian unsigned 32-bit numbers. Each partition of `docs` is packed as it
    is read, `limits.window` examples at a time, so nothing is shuffled and a lost task gives the same
    pieces again; a partition leaves one sequence with padding beyond `limits.slack` (more only where 64 segments
    or the loss limit close a sequence early). sequence_id is unique, not gapless.

    Null and empty texts are the single id END. Repeated rows are packed each for itself. Of examples
    with equal worth the one that waits at the lower place goes first. An empty table gives no rows. Other
    columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, loss_tokens bigint, "
              "sequence_id bigint, offset bigint, ids binary")
    names = [c.split()[0] for c in schema.split(", ")]
    read = docs.select("doc_id", F.col(prompt).alias("prompt") if prompt else F.lit("").alias("prompt"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, packer = Tokens.of(tokenizer), Packer(limits, TaskContext.get().partitionId() << 40)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                part, out = batch.iloc[start:start + TOGETHER], []
                before, texts = ([t or "" for t in part[c]] for c in ("prompt", "text"))
                for key, quiet, own in zip(part["doc_id"], tokens.ids(before), tokens.ids(texts)):
                    out.extend(packer.add(key, np.frombuffer(quiet + own + end, dtype="<u4"), len(quiet) // 4))
                yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(packer.rest()), columns=names)

    return read.mapInPandas(run, schema)
