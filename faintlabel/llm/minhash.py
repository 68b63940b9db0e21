"""Near-duplicate detection by an inverted join on MinHash signature coordinates.

Every set of shingles has a signature of minima.  Sets are posted under their (coordinate, value) pairs, the rarest
first: two sets that agree in T of K coordinates share one of their K - T + 1 rarest pairs at least, and a pair that no
other set has is skipped at once, so most sets post nothing.  Sets that meet under a pair are candidates; candidates
that agree in T coordinates are compared on their full sets.

Groups of copies: equal sets are one node.  In each posting list all nodes are first compared with the list's most
central node.  Lists that still hold several components are merged block against block: a meeting of two blocks counts
the coordinates in which their nodes agree and skips pairs of one component, pairs that meet under an earlier pair of
both, and sizes too far apart; only pairs above the match threshold leave it.  Where nearly all of a meeting's pairs are
above it (copies that differ by just too much), the meeting itself leaves, and its full sets are compared in place.  No
link between different components is lost, the pairs within a large component are never listed, and pairs that turn out
not to be linked are never rows of a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlabel.llm.common import components, remembered, slices, stored, with_keys
from faintlabel.session import ship_package

COORDINATES = 64
#: A linked pair is missed by the match threshold with at most this probability.
MISS = 1e-6
#: Words whose hashes a worker remembers; it starts anew when full.
MEMORY = 500_000
#: Candidate sets up to this many are named to all tasks that read the texts; more are joined by shuffle.
MOST_SENT = 1_000_000
#: Nodes of a block, fewer where a list has large sets: a block's sets take some 16 MB at most, down to 64 nodes.
BLOCK = 1024
BLOCK_BYTES = 16 << 20
#: Pairs per node from which on a meeting of blocks is compared in place.
DENSE = 4
_rng = np.random.default_rng(2)
WORD_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COORDINATE_FACTORS = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COORDINATE_SHIFTS = _rng.integers(0, 2**63, 512, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest T such that sets just similar enough agree in fewer than T coordinates with probability ``miss`` at most."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: ``words`` consecutive words, A-Z lower-cased, parted by the
    six ASCII blanks; a shorter text is one shingle, a text without words has none."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    hashes = remembered("minhash", _Hashes)
    ids = np.array([hashes[w] for w in split], np.uint64)
    size = min(words, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for j in range(size):
        out += _mixed(ids[j : len(ids) - size + 1 + j] * WORD_FACTORS[j])
        out *= WORD_FACTORS[63 - j]
    return np.unique(_mixed(out))


def signature_of(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    best = np.full(coordinates, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        hashed = shingles[at : at + 2048, None] * COORDINATE_FACTORS[:coordinates] + COORDINATE_SHIFTS[:coordinates]
        best = np.minimum(best, (hashed >> np.uint64(32)).min(0))
    return best


def _node(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None


def signatures(docs: DataFrame, keys: list[str], words: int, coordinates: int) -> DataFrame:
    """``keys``, n_shingles, node (a 64-bit digest of the set; null: empty set), signature and marks (the signature as
    32-bit numbers), from whole texts."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles_of(t, words) for t in batch.column("_text").to_pylist()]
            marks = [signature_of(s, coordinates) if len(s) else None for s in sets]
            lists = pa.array([None if m is None else m.astype(np.int64) for m in marks], pa.list_(pa.int64()))
            packed = pa.array([None if m is None else m.astype("<u4").tobytes() for m in marks], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), lists, packed],
                names=[*keys, "n_shingles", "node", "signature", "marks"],
            )

    given = docs.select(*keys, F.col("text").alias("_text"))
    return given.mapInArrow(run, with_keys(given, keys, "n_shingles long, node long, signature array<long>, marks binary"))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and shingles (sorted 64-bit hashes as bytes) of every text that has words."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s for s in (shingles_of(t, words) for t in batch.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def postings(classes: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """node, token and weight: the prefix of each node's (coordinate, value) pairs in the order of their frequency.

    Pairs of one node alone come first in that order and meet nobody, so a node with ``coordinates - threshold + 1`` of
    them posts nothing.  weight: how often the node's pairs occur in all; the most central node of a group has most.
    """
    tokens = classes.select("node", F.posexplode("signature").alias("_j", "_v")).select("node", (F.shiftleft(F.col("_j").cast("long"), 32) + F.col("_v")).alias("token"))
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    own = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("_own"), F.sum("n").alias("weight"))  # up to one per coordinate
    places = F.lit(coordinates - threshold + 1) - (F.lit(coordinates) - F.size("_own"))
    own = own.withColumn("_take", places).where("_take > 0")
    return own.select("node", "weight", F.explode(F.slice("_own", F.lit(1), F.col("_take"))).alias("_t")).select("node", "weight", "_t.token")


def _agreeing(pairs: DataFrame, classes: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree in ``threshold`` coordinates."""
    one = classes.select(F.col("node").alias("a"), F.col("signature").alias("_sa"), F.col("n_shingles").alias("_na"))
    other = classes.select(F.col("node").alias("b"), F.col("signature").alias("_sb"), F.col("n_shingles").alias("_nb"))
    same = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda x: x))
    fits = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
    return pairs.join(one, "a").join(other, "b").where(fits & (same >= threshold)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b")
    return both.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and shingles, once per node; only the texts of one document per node are read again."""
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", F.col("first_doc").alias("doc_id")), "wanted")
    names = wanted.select(F.col("doc_id").alias("_doc"))
    names = F.broadcast(names) if wanted.count() <= MOST_SENT else names
    texts = docs.join(names, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    # a doc_id may have other texts too, and rows may repeat
    sets = shingle_sets(texts.dropDuplicates(["doc_id", "text_key"]), words).join(wanted.select("node"), "node", "left_semi")
    return stored(sets.dropDuplicates(["node"]), "sets")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that hold on full sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return stored(_confirmed(pairs, _sets_of(docs, classes, nodes, words), percent).distinct(), "links")


def _mixed_lists(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """node, token, label and _top (the label of most) of the posting lists with nodes of more than one component."""
    labelled = stored(posts.join(labels, "node", "left").select("node", "token", F.coalesce("label", "node").alias("label")), "labelled")
    heads = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("_n"))
    mixed = heads.groupBy("token").agg(F.count(F.lit(1)).alias("_labels"), F.max(F.struct("_n", "label")).alias("_top")).where("_labels > 1")
    return stored(labelled.join(stored(mixed.select("token", F.col("_top.label").alias("_top")), "mixed"), "token"), "lists")


def _meetings(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """meeting, token, side (0 or 1; a block may meet itself, all on side 0), node, label and first: the blocks of each list
    that have pairs to compare.

    ``first`` is the node's smallest token among the lists; two nodes of the same first have met there.  Nodes of the
    list's largest component are blocks of their own, which do not meet each other; the others are dealt to blocks of up
    to about as many nodes as there is room for by their first, so that blocks of one first need not meet under another token.
    """
    rows = lists.join(lists.groupBy("node").agg(F.min("token").alias("first")), "node")
    largest = lists.join(classes.select("node", "n_shingles"), "node").groupBy("token").agg(F.max("n_shingles").alias("_most"))
    room = F.greatest(F.lit(min(64, BLOCK)), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES // 8) / F.col("_most")))).cast("int")
    rooms = stored(largest.select("token", room.alias("_room")), "rooms")
    inside = F.col("label") == F.col("_top")
    rows = rows.select("token", "node", "label", "first", inside.alias("_in"), F.when(inside, -1).otherwise(F.col("first")).alias("_g"))
    sizes = rows.groupBy("token", "_in", "_g").agg(F.count(F.lit(1)).alias("_n")).join(rooms, "token")
    own = F.col("_in") | (2 * F.col("_n") >= F.col("_room"))
    rest = F.sum(F.when(~own, F.col("_n"))).over(Window.partitionBy("token"))  # one row per first
    sizes = sizes.withColumn("_rest", F.coalesce(rest, F.lit(0)))
    chunk = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / F.col("_room")))).otherwise(
        F.pmod(F.xxhash64("_g", F.lit(1)), F.greatest(F.ceil(F.col("_rest") / F.col("_room")), F.lit(1)))
    )
    block = F.xxhash64("_in", F.when(own, F.col("_g")).otherwise(-2), chunk)
    placed = stored(rows.join(sizes, ["token", "_in", "_g"]).select("token", block.alias("block"), "node", "label", "first", "_in"), "placed")
    blocks = placed.groupBy("token", "block").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.max("_in").alias("_in"), F.count(F.lit(1)).alias("n"))
    blocks = stored(blocks, "blocks")
    one, other = (blocks.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("block", "lo", "hi", "_in", "n")]) for x in "xy")
    met_before = (F.col("x_lo") == F.col("x_hi")) & (F.col("y_lo") == F.col("y_hi")) & (F.col("x_lo") == F.col("y_lo")) & (F.col("x_lo") != F.col("token"))
    alone = (F.col("x_block") == F.col("y_block")) & (F.col("x_n") == 1)
    pairs = one.join(other, "token").where((F.col("x_block") <= F.col("y_block")) & ~(F.col("x__in") & F.col("y__in")) & ~met_before & ~alone)
    pairs = pairs.select(F.xxhash64("token", "x_block", "y_block").alias("meeting"), "token", "x_block", "y_block")
    sides = F.when(F.col("x_block") == F.col("y_block"), F.array(F.struct(F.lit(0).alias("side"), F.col("x_block").alias("block"))))
    sides = sides.otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x_block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y_block").alias("block"))))
    guests = pairs.select("meeting", "token", F.explode(sides).alias("_s")).select("meeting", "token", "_s.side", "_s.block")
    return placed.join(guests, ["token", "block"]).select("meeting", "token", "side", "node", "label", "first")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one meeting at a time, from batches in the order of meetings."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = batch.column("meeting").to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("meeting")[0].as_py() != names[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _askable(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of either side of a meeting, their nodes, and which pairs are to be compared: of different components, not met
    before, with sizes that allow the similarity; each pair once."""
    side, node, label, first, n = (group.column(c).to_numpy() for c in ("side", "node", "label", "first", "n_shingles"))
    token = group.column("token")[0].as_py()
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(y)
    y = x if same else y
    fx, fy = first[x][:, None], first[y][None, :]
    asked = (label[x][:, None] != label[y][None, :]) & ((fx != fy) | (fx == token))
    asked &= 100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :])
    if same:
        asked &= np.triu(np.ones(asked.shape, bool), 1)
    return x, y, node, asked


def _paired(node: np.ndarray, x: np.ndarray, y: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(found)
    a, b = node[x[i]], node[y[j]]
    return np.minimum(a, b), np.maximum(a, b)


def _compared(guests: DataFrame, threshold: int, percent: int) -> DataFrame:
    """meeting, a and b: pairs that agree in ``threshold`` coordinates; where they are over ``DENSE`` times as many as the
    nodes of the meeting, the meeting alone, with null nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            x, y, node, asked = _askable(group, percent)
            marks = np.stack([np.frombuffer(m, "<u4") for m in group.column("marks").to_pylist()])
            agree = np.zeros(asked.shape, np.int16)
            for j in range(marks.shape[1]):
                agree += marks[x, j][:, None] == marks[y, j][None, :]
            a, b = _paired(node, x, y, asked & (agree >= threshold))
            meeting = group.column("meeting")[0].as_py()
            if len(a) > DENSE * group.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([meeting]), pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=["meeting", "a", "b"])
            elif len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), meeting)), pa.array(a), pa.array(b)], names=["meeting", "a", "b"])

    return guests.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "meeting long, a long, b long")


def _shared_sizes(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intersection sizes of all sets of ``x`` with all of ``y``, by products of columns of their incidence."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += np.rint(part[x] @ part[y].T).astype(np.int64)
    return out


def _compared_in_place(guests: DataFrame, percent: int) -> DataFrame:
    """a and b: the linked pairs of meetings whose guests bring their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            x, y, node, asked = _askable(group, percent)
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            n = group.column("n_shingles").to_numpy()
            shared = _shared_sizes(sets, x, y)
            a, b = _paired(node, x, y, asked & (100 * shared >= percent * (n[x][:, None] + n[y][None, :] - shared)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return guests.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long")


def _links_across(given: DataFrame, classes: DataFrame, lists: DataFrame, words: int, percent: int, threshold: int) -> DataFrame:
    """Links between nodes of different components that share a posting list."""
    meetings = stored(_meetings(lists, classes), "meetings")
    known = classes.select("node", "n_shingles", "marks")
    found = stored(_compared(meetings.join(known, "node"), threshold, percent), "compared")
    pairs = stored(found.where("b is not null").select("a", "b").distinct(), "pairs")
    links = _links(given, classes, pairs, words, percent)
    dense = found.where("b is null").select("meeting").distinct()
    if dense.isEmpty():
        return links
    guests = stored(meetings.join(dense, "meeting", "left_semi").join(classes.select("node", "n_shingles"), "node"), "guests")
    sets = _sets_of(given, classes, guests.select("node").distinct(), words)
    return links.unionAll(stored(_compared_in_place(guests.join(sets, "node"), percent), "in-place"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, text_key (a hash of the text), label (of the component; null: no shingles), component_id and
    kept of every row of ``docs`` (doc_id, text; other columns are not read).

    Rows are linked if 100 * shared shingles >= percent * shingles of either; component_id is the smallest doc_id that
    links reach.  Null and empty texts have no shingles and are linked with nothing; repeated rows and equal texts share
    a component; a null doc_id never is a component's smallest unless all are null.
    """
    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    threshold = match_threshold(percent, coordinates, miss)
    rows = stored(signatures(given, ["doc_id", "text_key"], words, coordinates), "signatures")
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.min("marks").alias("marks"))
    classes = stored(classes, "classes")
    posts = stored(postings(classes, coordinates, threshold), "posts")

    centres = posts.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("_c")).select("token", F.col("_c.node").alias("b"))
    star = posts.join(stored(centres, "centres"), "token").where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    star = stored(star, "star")
    links = _links(given, classes, stored(_agreeing(star, classes, threshold, percent), "agreeing"), words, percent)
    labels = stored(components(links), "labels")

    lists = _mixed_lists(posts, labels)
    if not lists.isEmpty():
        links = stored(links.unionAll(_links_across(given, classes, lists, words, percent, threshold)), "links")
        labels = stored(components(links), "labels")

    named = classes.join(labels, "node", "left").withColumn("_label", F.coalesce("label", "node")).select("node", "_label", "first_doc", "copies")
    ids = named.groupBy("_label").agg(F.min("first_doc").alias("component_id"), F.sum("copies").alias("_rows")).where("_rows > 1")
    found = stored(named.select("node", "_label").join(stored(ids, "ids"), "_label").select("node", F.col("_label").alias("label"), "component_id"), "found")
    out = rows.select("doc_id", "text_key", "n_shingles", "node").join(found, "node", "left")
    out = out.withColumn("label", F.coalesce("label", "node")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.drop("node").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, then text hash.  Rows without shingles all stay."""
    told = stored(near_duplicates(docs, words, percent).select("doc_id", "text_key", "label"), "told")
    first = told.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("_f"))
    chosen = first.select(F.col("_f.doc_id").alias("_doc"), F.col("_f.text_key").alias("_key"))
    again = told.where("label is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = again.select(F.col("doc_id").alias("_again"), F.col("text_key").alias("_again_key"))
    empty = told.where("label is null").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    # whole rows in one column, so that no column of theirs clashes
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_own"))
    kept = rows.join(chosen.unionAll(empty), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_key")), "left_semi")
    if again.isEmpty():
        return kept.select("_row.*")
    same = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_own") == F.col("_again_key"))
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["_id", "_own"])
    return kept.join(again, same, "left_anti").unionAll(repeated).select("_row.*")
