"""Byte-level BPE by a rank queue on a hierarchical bitmap, and the way back from ids to bytes.

A pre-token is a linked list of byte spans.  Each possible merge lies in the bucket of its rank; two levels of bitmaps
tell which buckets hold something, so the next rank is two find-first-set steps away and a pre-token of n bytes costs
about n steps, however long it is.  A bucket entry whose pair has changed meanwhile is stale and skipped.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlabel.llm.common import Words, portions, remembered, slices, text_of, with_keys
from faintlabel.session import ship_package

LEAF_BITS = 8
#: Longer words are not remembered.
LONGEST_KEPT = 64
#: Texts whose unknown words are encoded together, and the letters of unknown words from which on they are.
STEP = 4_096
LETTERS = 600_000
#: Stands between pre-tokens; no merge has it.
WALL = (1 << 17) - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class RankQueue:
    """Non-empty buckets by rank: two levels of bitmaps, two find-first-set steps to the lowest."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def put(self, rank: int, places: list[int]) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held += places
            return
        self.buckets[rank] = places
        leaf = rank >> LEAF_BITS
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 255)
        self.top |= 1 << leaf

    def lowest(self) -> int:
        """The lowest rank in the queue; call only while ``top`` is not 0."""
        leaf = (self.top & -self.top).bit_length() - 1
        bits = self.leaves[leaf]
        return leaf << LEAF_BITS | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        leaf = rank >> LEAF_BITS
        self.leaves[leaf] ^= 1 << (rank & 255)
        if not self.leaves[leaf]:
            self.top ^= 1 << leaf
        return self.buckets.pop(rank)


class Merger:
    """Encodes many pre-tokens in one queue: they lie in one linked list with walls between, so that a bucket's places
    in different pre-tokens are merged by array operations together."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 17 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte_ids = np.array([ranks.get(bytes([b]), WALL) for b in range(256)], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they don't merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        wanted = left << 17 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)

    def encode(self, pieces: list[bytes], known: list[tuple[int, int]], words: list[int]) -> list[bytes]:
        """Ids (32-bit) of words, given as runs of ``words[i]`` pieces; ``known``: (place in pieces, id of that piece as a whole)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        walls = np.concatenate(([0], np.cumsum(sizes + 1)))
        ids = self.byte_ids[raw]
        ids[walls] = WALL
        n = len(ids)
        fixed = np.array(known, np.int64).reshape(-1, 2)
        single = walls[fixed[:, 0]] + 1
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        rank_at = np.full(n, -1, np.int64)
        rank_at[:-1] = self.rank_of(ids[:-1], ids[1:])
        ids[single] = fixed[:, 1]
        queue = RankQueue()
        self._put(queue, np.flatnonzero(rank_at >= 0), rank_at)
        while queue.top:
            rank = queue.lowest()
            at = np.array(queue.take(rank), np.int64)
            at = at[rank_at[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = self._apart(at[np.concatenate(([True], at[1:] != at[:-1]))], following)
            gone = following[at]
            after = following[gone]
            alive[gone] = False
            ids[at] = rank
            rank_at[gone] = -1
            following[at] = after
            before[after] = at
            # a neighbour to the left may have merged in this step too: its own pair covers this one
            left = before[at]
            right_rank, left_rank = self.rank_of(ids[at], ids[after]), self.rank_of(ids[left], ids[at])
            rank_at[at] = right_rank
            rank_at[left] = left_rank
            self._put(queue, at[right_rank >= 0], rank_at)
            self._put(queue, left[left_rank >= 0], rank_at)
        wall = np.zeros(n, bool)
        wall[walls] = True
        kept = np.flatnonzero(alive & ~wall)
        found = ids[kept].astype(np.int32).tobytes()
        ends = np.searchsorted(kept, walls[np.cumsum(words)]) * 4
        return [found[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(queue: RankQueue, at: np.ndarray, rank_at: np.ndarray) -> None:
        if len(at) < 64:
            for place, rank in zip(at.tolist(), rank_at[at].tolist(), strict=True):
                queue.put(rank, [place])
            return
        ranks = rank_at[at]
        order = np.argsort(ranks, kind="stable")
        found, starts = np.unique(ranks[order], return_index=True)
        places = at[order].tolist()
        ends = [*starts[1:].tolist(), len(places)]
        for rank, a, b in zip(found.tolist(), starts.tolist(), ends, strict=True):
            queue.put(rank, places[a:b])

    @staticmethod
    def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Of places whose pairs overlap (runs of one token) every other one, from the left; the rest turns stale."""
        touches = following[at[:-1]] == at[1:]
        if not touches.any():
            return at
        index = np.arange(len(at))
        start = np.concatenate(([True], ~touches))
        run_start = np.maximum.accumulate(np.where(start, index, 0))
        return at[(index - run_start) % 2 == 0]


class Encoder:
    """Encodes whole texts; remembers the ids of short words."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.merger = Merger(self.ranks)
        self.pattern = regex.compile(pattern)
        self.double_blank = regex.compile(r"\s\s")
        #: Pieces of text as they stand, and words with a space before them.
        self.plain, self.spaced = Words(), Words()
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))

    def units(self, text: str) -> tuple[list[str], list[str]]:
        """A text as parts that no match of the pattern crosses, and the words that follow them, each after a space.

        Where no two blanks meet, a single space always begins a match, so the text may be cut there; other texts go
        through the pattern itself.
        """
        if self.double_blank.search(text):
            return self.pattern.findall(text), []
        parts = text.split(" ")
        return parts[:1], parts[1:]

    def learn(self, words: set[str], space: str) -> dict[str, bytes]:
        pieces: list[bytes] = []
        whole: list[tuple[int, int]] = []
        counts = []
        ordered = list(words)
        find, split, rank_of = pieces.append, self.pattern.findall, self.ranks.get
        for word in ordered:
            parts = (space + word,) if word.isalpha() else split(space + word)
            for part in parts:
                raw = part.encode()
                rank = rank_of(raw)
                if rank is None:
                    find(raw)
                else:
                    whole.append((len(pieces), rank))
                    find(b"\1")
            counts.append(len(parts))
        return dict(zip(ordered, self.merger.encode(pieces, whole, counts), strict=True)) if ordered else {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text.  Unknown words of some texts are encoded in one queue before those texts are put together."""
        at = 0
        while at < len(texts):
            self.plain.turn()
            self.spaced.turn()
            plain: set[str] = set()
            spaced: set[str] = set()
            letters, split = 0, []
            while at + len(split) < len(texts) and letters < LETTERS:
                head, rest = self.units(texts[at + len(split)])
                split.append((head, rest))
                for words, known, new in ((head, self.plain, plain), (rest, self.spaced, spaced)):
                    unknown = known.missing(set(words).difference(new))
                    new |= unknown
                    letters += sum(map(len, unknown))
            at += len(split)
            for known, new, space in ((self.plain, plain, ""), (self.spaced, spaced, " ")):
                for word, ids in self.learn(new, space).items():
                    known.add(word, ids)
            for head, rest in split:
                yield np.frombuffer(b"".join([*map(self.plain.young.__getitem__, head), *map(self.spaced.young.__getitem__, rest)]), np.int32)
            for known, new in ((self.plain, plain), (self.spaced, spaced)):
                known.drop([w for w in new if len(w) > LONGEST_KEPT])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encoder(data: bytes, pattern: str) -> Encoder:
    return remembered(("bpe", zlib.crc32(data), pattern), lambda: Encoder(data, pattern))


def encode(docs: DataFrame, keys: list[str], ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of every whole text, with ``decoded`` also the bytes that the ids stand for.
    Null and empty texts have no ids and no bytes, repeated rows are encoded each."""
    ship_package(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(data.value, pattern)
        for batch in slices(batches, STEP):
            for at, ids in portions(own.encode(text_of(batch, "_text"))):
                part = batch.slice(at, len(ids))
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *columns], names=[*keys, "ids", *["decoded"] * decoded])

    given = docs.select(*keys, F.col("text").alias("_text"))
    return given.mapInArrow(run, with_keys(given, keys, "ids array<int>" + ", decoded binary" * decoded))


def decode(encoded: DataFrame, keys: list[str], ranks_path: str) -> DataFrame:
    """``keys`` and ``decoded``, the bytes that the ids stand for; null ids give no bytes."""
    ship_package(encoded.sparkSession)
    data = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = remembered(("tokens", zlib.crc32(data.value)), lambda: {rank: token for token, rank in read_ranks(data.value).items()})
        for batch in slices(batches):
            texts = [b"".join(map(by_rank.__getitem__, x.tolist())) for x in _arrays(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.binary())], names=[*keys, "decoded"])

    given = encoded.select(*keys, "ids")
    return given.mapInArrow(run, with_keys(given, keys, "decoded binary"))


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i in range(len(column)):
        yield flat[ends[i] : ends[i + 1]] if column[i].is_valid else flat[:0]


def joined(ids: str) -> Column:
    """Decimal ids, joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
