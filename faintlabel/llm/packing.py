"""Packing token sequences as a cutting-stock problem.

Documents are cut into pieces of at most the capacity; the pieces' lengths, rounded up to classes, give a histogram of
constant size.  Column generation on it: a linear program over patterns (how many pieces of each class fill one
sequence), whose dual prices a knapsack dynamic program turns into the next pattern.  The patterns' rounded-down counts
and a first-fit filling of what is left are a plan over classes; every piece finds its sequence by its rank in its class.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from faintlabel.llm.common import ENTRY, bucket_count, portions, ranked, remembered, running, slices, stored, text_of, with_keys
from faintlabel.session import ship_package

CAPACITY = 4096
#: Classes in each doubling of the length; lengths up to twice as many are classes of their own.
PER_OCTAVE = 8
LONGEST_KEPT = 64
#: Bytes of a generation of words.
MEMORY = 32 << 20
#: Texts taken at a time, and the letters of unknown words from which on those are encoded.
STEP = 1_024
LETTERS = 400_000
#: Texts of these characters only need no other normalisation than lower case, and no blank of them can join two words.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*")
#: Fixed value: the vocabulary's own split pattern.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Fixed value: what the last token of each piece ends with in that vocabulary.
PIECE_END = "</w>"


class Known(dict):
    """Ids of words by two generations of bounded size; what is met again moves to the younger, which this is.

    A word is looked up once, where it stands: one that neither generation has gets an empty place, filled before it is read.
    """

    def __init__(self, old: dict[str, bytes]) -> None:
        self.old, self.places = old, {}
        self.size = self.letters = 0

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is None:
            ids = self.places[word] = bytearray()
            self.letters += len(word)
        else:
            self.size += ENTRY + len(word) + len(ids)
        self[word] = ids
        return ids

    def turned(self) -> Known:
        """Between texts: a full generation becomes the old one."""
        if self.size <= MEMORY:
            return self
        self.old = {}
        return Known(self)

    def has(self, word: str) -> bytes | bytearray | None:
        """Its ids if they are known; nothing is moved."""
        return self.get(word) or self.old.get(word)

    def fill(self, ids: dict[str, bytes]) -> None:
        for word, place in self.places.items():
            place += ids[word]
            if len(word) > LONGEST_KEPT:
                del self[word]
            else:
                self[word] = ids[word]
                self.size += ENTRY + len(word) + len(place)
        self.places, self.letters = {}, 0


class WordEncoder:
    """Ids by the tokenizers library, asked once for each distinct piece of the words that are new in a batch."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; every thread keeps memory of its own
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = Tokenizer(self.tokenizer.model)  # the same model, for pieces: those are lower case and split already
        whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), whole])
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(PIECE_END)]] = True
        self.known = Known({})

    def _encode_pieces(self, pieces: list[str], together: int = 500) -> dict[str, bytes]:
        """Many pieces are encoded in one string; the tokens that end a piece tell where it is cut."""
        out: dict[str, bytes] = {}
        groups = [pieces[i : i + together] for i in range(0, len(pieces), together)]
        found = self.pieces.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found, strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(group):
                out |= {p: np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in group}
                continue
            raw = ids.tobytes()
            out.update(zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
        return out

    def learn(self, words: Collection[str]) -> dict[str, bytes]:
        """Ids of words, from those of their pieces; a piece that is a known word is not encoded again."""
        split = {w: PIECES.findall(w) for w in words if not w.isalpha()}
        new = {w for w in words if w not in split}
        others = set().union(*split.values()) - new
        ids = {p: found for p in others if (found := self.known.has(p))}
        new |= others.difference(ids)
        ids |= self._encode_pieces(list(new))
        ids |= {w: b"".join([ids[p] for p in parts]) for w, parts in split.items()}
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts.  The unknown words of some texts are learnt together before
        those texts are put together."""
        at = 0
        while at < len(texts):
            known = self.known = self.known.turned()
            split: list[list[bytes | bytearray] | None] = []
            while at + len(split) < len(texts) and known.letters < LETTERS:
                text = texts[at + len(split)]
                split.append(list(map(known.__getitem__, text.lower().split())) if self.is_plain(text) else None)
            known.fill(self.learn(known.places))
            for found in split:
                if found is None:
                    yield np.array(self.tokenizer.encode(texts[at], add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield b"".join(found)
                at += 1

    @staticmethod
    def is_plain(text: str) -> bool:
        """Whether lower case is all that the text needs before it is split at blanks."""
        known = (text.isascii() and text.replace("\n", "").isprintable()) or PLAIN.fullmatch(text) is not None
        return known and "<|" not in text


def word_encoder(data: bytes) -> WordEncoder:
    return remembered(("packing", zlib.crc32(data)), lambda: WordEncoder(data))


def encode_pieces(docs: DataFrame, keys: list[str], tokenizer_path: str, end_id: int, capacity: int = CAPACITY, spans: str | None = None) -> DataFrame:
    """``keys``, start, length, doc_tokens and ids (binary: little-endian unsigned 32-bit) of every piece of every text.

    A document's ids are those of its whole text (null: empty) and then ``end_id``.  It is cut every ``capacity`` ids,
    or, where ``spans`` names a column of (start, length) structs, at those.
    """
    ship_package(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())  # as large as the vocabulary file
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(data.value)
        for whole in slices(batches, STEP):
            for at, encoded in portions(own.encode(text_of(whole, "_text"))):
                batch = whole.slice(at, len(encoded))
                row, starts, sizes, totals, ids = [], [], [], [], []
                cuts = batch.column("_spans").to_pylist() if spans else [None] * len(encoded)
                for i, (found, cut) in enumerate(zip(encoded, cuts, strict=True)):
                    raw = found + end
                    total = len(raw) // 4
                    if cut is None:
                        cut = [{"start": s, "length": min(capacity, total - s)} for s in range(0, total, capacity)]
                    for c in cut:
                        row.append(i)
                        starts.append(c["start"])
                        sizes.append(c["length"])
                        totals.append(total)
                        ids.append(raw[4 * c["start"] : 4 * (c["start"] + c["length"])])
                rows = pa.array(row, pa.int64())
                columns = [batch.column(c).take(rows) for c in keys]
                columns += [pa.array(x, pa.int64()) for x in (starts, sizes, totals)] + [pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "start", "length", "doc_tokens", "ids"])

    given = docs.select(*keys, F.col("text").alias("_text"), *([F.col(spans).alias("_spans")] if spans else []))
    return given.mapInArrow(run, with_keys(given, keys, "start long, length long, doc_tokens long, ids binary"))


def length_class(length: Column, capacity: int = CAPACITY, per_octave: int = PER_OCTAVE) -> Column:
    """The class of a length: itself up to twice ``per_octave``, above that rounded up in steps that double with it."""
    out, width, top = length, 2, 2 * per_octave
    while top < capacity:
        out = F.when(length > top, F.ceil(length / width) * width).otherwise(out)
        width, top = width * 2, top * 2
    return F.least(out.cast("int"), F.lit(capacity))


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences with the same (class, pieces) pairs."""

    times: int
    parts: tuple[tuple[int, int], ...]


def _best_fill(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack with repetition: the dearest pattern within the capacity, by doubling the copies of each class."""
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-prices / sizes):
        if prices[i] <= 1e-12:
            continue
        copies = 1
        while copies * sizes[i] <= capacity:
            shift = copies * int(sizes[i])
            tried = best[: capacity + 1 - shift] + copies * prices[i]
            better = tried > best[shift:] + 1e-12
            if better.any():
                grown = best.copy()
                np.copyto(grown[shift:], tried, where=better)
                best = grown
                steps.append((int(i), copies, better))
            copies *= 2
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for i, copies, better in reversed(steps):
        shift = copies * int(sizes[i])
        if room >= shift and better[room - shift]:
            counts[i] += copies
            room -= shift
    return float(best[capacity]), counts


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, most: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: (patterns x classes, how often each).  Starts from one-class patterns; ends when no pattern is
    worth more than a sequence by over ``gap``, which bounds the distance to the optimum by the same share."""
    m = len(sizes)
    single = capacity // sizes
    columns = np.diag(single).astype(float)
    inverse = np.diag(1.0 / single)
    used = demand / single
    for step in range(most):
        prices = inverse.sum(0)
        worth, pattern = _best_fill(sizes, prices, capacity)
        if worth <= 1 + gap:
            break
        direction = inverse @ pattern
        can = direction > 1e-9
        ratio = np.where(can, used / np.where(can, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        amount = ratio[leave]
        used = np.maximum(used - amount * direction, 0)
        used[leave] = amount
        columns[:, leave] = pattern
        if step % 250 == 249:
            inverse = np.linalg.inv(columns)
            used = np.maximum(inverse @ demand, 0)
        else:
            pivot = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, pivot)
            inverse[leave] = pivot
    return columns.T.astype(np.int64).reshape(-1, m), used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = 0.002) -> list[Pattern]:
    """Patterns that hold every piece of the histogram exactly once.  Depends on the histogram only."""
    out = [Pattern(histogram[capacity], ((capacity, 1),))] if histogram.get(capacity) else []
    sizes = np.array(sorted(c for c, n in histogram.items() if n and c < capacity), np.int64)
    if not len(sizes):
        return out
    left = np.array([histogram[int(c)] for c in sizes], np.int64)
    patterns, used = fractional_patterns(sizes, left.astype(float), capacity, gap)
    for pattern, x in sorted(zip(patterns.tolist(), used.tolist(), strict=True), key=lambda p: -p[1]):
        fits = [left[i] // k for i, k in enumerate(pattern) if k]
        times = min([int(x + 1e-7), *map(int, fits)]) if fits else 0
        if times > 0:
            out.append(Pattern(times, tuple((int(sizes[i]), k) for i, k in enumerate(pattern) if k)))
            left -= times * np.array(pattern)
    while left.any():  # first fit, the longest first; at most about as many sequences as there are classes
        room, parts = capacity, []
        for i in range(len(sizes) - 1, -1, -1):
            if take := min(int(left[i]), room // int(sizes[i])):
                parts.append((int(sizes[i]), take))
                room -= take * int(sizes[i])
        needed = {s: k for s, k in parts}
        index = {int(s): i for i, s in enumerate(sizes)}
        times = min(int(left[index[s]]) // k for s, k in parts)
        out.append(Pattern(times, tuple(parts)))
        for s, k in needed.items():
            left[index[s]] -= times * k
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, gap: float = 0.002) -> DataFrame:
    """The pieces with sequence_id, offset and cut (true: it is a part of the given piece).

    ``pieces`` has start and length (1 to capacity) and is read several times, so it should be a stored table; other
    columns go along.  ``order`` ranks pieces of equal class.  With T tokens in all, the T // capacity sequences that the
    plan fills best are kept; what lies in the others is laid end to end and cut to fill the gaps that rounding up to
    classes has left, and the last T % capacity tokens make sequences of powers of two.  So no sequence needs padding.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumn("_class", length_class(F.col("length"), capacity))
    counts = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).collect()
    tokens = sum(r["tokens"] for r in counts)
    patterns = sorted(plan({r["_class"]: r["n"] for r in counts}, capacity, gap), key=lambda p: -sum(size * each for size, each in p.parts))
    rows, used, sequence = [], dict.fromkeys((r["_class"] for r in counts), 0), 0
    for p in patterns:
        for size, each in p.parts:
            rows.append((size, used[size], used[size] + p.times * each, each, sequence))
            used[size] += p.times * each
        sequence += p.times
    full = tokens // capacity
    # classes x patterns: some thousand rows, however many documents
    slots = F.broadcast(spark.createDataFrame(rows, "_slot int, _from long, _to long, _each long, _first long"))
    columns = [F.col(c) for c in order]
    buckets = bucket_count(sum(r["n"] for r in counts))
    placed = ranked(classed, ["_class"], columns, columns, "_rank", buckets)
    rank = F.col("_rank")
    placed = placed.join(slots, (F.col("_class") == F.col("_slot")) & (rank >= F.col("_from")) & (rank < F.col("_to")))
    placed = placed.withColumn("_sequence", F.col("_first") + F.floor((rank - F.col("_from")) / F.col("_each")))
    before = Window.partitionBy("_sequence").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col(c) for c in pieces.columns]
    placed = stored(placed.select(*columns, "_class", "_rank", "_sequence", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_offset")), "placed")
    kept = placed.where(F.col("_sequence") < full).select(*columns, F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"), F.lit(False).alias("cut"))

    filled = placed.where(F.col("_sequence") < full).groupBy("_sequence").agg(F.sum("length").alias("_filled"))
    gaps = filled.select("_sequence", F.col("_filled").alias("_at"), (capacity - F.col("_filled")).alias("_size")).where("_size > 0")
    left, last = tokens % capacity, []
    for bit in range(capacity.bit_length()):
        if left >> bit & 1:
            last.append((full + len(last), 0, 1 << bit))
    if last:
        gaps = gaps.unionAll(spark.createDataFrame(last, "_sequence long, _at long, _size long"))
    gaps = running(gaps, "_size", [F.col("_sequence")], "_lo", buckets).select("_sequence", "_at", F.col("_lo").alias("_gap"), (F.col("_lo") + F.col("_size")).alias("_gap_end"))
    loose = placed.where(F.col("_sequence") >= full)
    loose = running(loose, "length", [F.col("_class"), rank], "_lo", buckets).withColumn("_hi", F.col("_lo") + F.col("length"))

    def blocks(lo: str, hi: str) -> Column:
        """Stretches of the stream, of one capacity each, that an interval touches: both sides meet within a stretch."""
        return F.explode(F.sequence(F.floor(F.col(lo) / capacity), F.floor((F.col(hi) - 1) / capacity)))

    first, end = F.greatest("_lo", "_gap"), F.least("_hi", "_gap_end")
    met = loose.withColumn("_block", blocks("_lo", "_hi")).join(gaps.withColumn("_block", blocks("_gap", "_gap_end")).withColumnRenamed("_sequence", "_into"), "_block")
    met = met.where((first < end) & (F.floor(first / capacity) == F.col("_block")))
    rest = {"start": F.col("start") + first - F.col("_lo"), "length": end - first}
    cut = met.select(
        *[rest[c].alias(c) if c in rest else F.col(c) for c in pieces.columns],
        F.col("_into").alias("sequence_id"),
        (F.col("_at") + first - F.col("_gap")).alias("offset"),
        (F.col("length") > end - first).alias("cut"),
    )
    return kept.unionByName(cut)


#: Cut documents up to this many are sent to all tasks to find their texts; more are joined by shuffle.
MOST_SENT = 100_000


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, digest=F.crc32) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ``digest`` of the ids, for every piece of every document.

    Null and empty texts have the end id alone; rows with a null or repeated doc_id are packed like others; an empty
    table gives no pieces.  Of ``docs`` only doc_id and text are read; the ids stay out of all shuffles.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text_key", F.xxhash64("text"))
    keys = ["doc_id", "_text_key"]
    grid = encode_pieces(given, keys, tokenizer_path, end_id, capacity)
    pieces = stored(grid.withColumn("digest", digest("ids")).drop("ids"), "pieces")
    packed = stored(pack(pieces, ["doc_id", "start", "_text_key"], capacity), "packed")
    kept = packed.where("not cut").drop("cut")
    again = packed.where("cut").select(*keys, "start", "length").distinct()
    again = again.groupBy(*keys).agg(F.collect_list(F.struct("start", "length")).alias("_spans"))  # a document has one piece under the capacity
    many = packed.where("cut").select(*keys).distinct().count()
    cut = packed.where("cut").drop("cut", "digest")
    if not many:
        return kept.drop("_text_key")
    wanted = F.broadcast(again) if many <= MOST_SENT else again
    wanted = wanted.withColumnsRenamed({"doc_id": "_doc", "_text_key": "_key"})
    found = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")))
    found = found.dropDuplicates(keys)
    digests = encode_pieces(found, keys, tokenizer_path, end_id, capacity, "_spans").select(
        F.col("doc_id").alias("_doc"), F.col("_text_key").alias("_key"), F.col("start").alias("_start"), F.col("length").alias("_length"), digest("ids").alias("digest")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")) & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length"))
    redone = cut.join(digests, same).select(*kept.columns)
    return kept.unionByName(redone).drop("_text_key")
