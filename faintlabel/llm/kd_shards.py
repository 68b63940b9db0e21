"""Shards of near equal bytes from a k-d tree over document metadata, with DataFrame functions only.

Each node of the tree is cut along its widest dimension at the weighted quantile that gives either side its share of the
leaves.  A place along a dimension is a sequence of digits: the dimension's own, then a hash of the text, then a hash of
the row's key.  The cut is found digit by digit from sums per digit, for all nodes of a level in one job.  Equal texts
share all digits but the last, so a cut goes through a group of them only if the group is too heavy to be put to either
side as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintlabel.llm.common import bucket_count, ranked, stored

DIGIT = 4096
TEXT_DIGITS, KEY_DIGITS = 3, 3
TEXT_END = 1 + TEXT_DIGITS
DEPTH = TEXT_END + KEY_DIGITS
#: Where this many rows or fewer are left around a cut, several of their digits are looked at in one job.
FEW_ROWS = 50_000


@dataclass
class Node:
    """A part of the rows that ``leaves`` shards from ``first`` on will hold."""

    name: int
    first: int
    leaves: int
    dimension: int = 0
    cut: list[int] = field(default_factory=list)


def _local(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of the driver, as SQL values, to be sent to all tasks."""

    def literal(x: object) -> str:
        return f"array({', '.join(map(str, x))})" if isinstance(x, list) and x else "cast(array() as array<int>)" if isinstance(x, list) else f"{x!r}D" if isinstance(x, float) else str(x)

    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


def _digits(hashed: Column, count: int) -> list[Column]:
    return [F.shiftrightunsigned(hashed, 12 * i).bitwiseAND(DIGIT - 1).cast("int") for i in range(count)]


def dimensions(docs: DataFrame, text: Column) -> list[Column]:
    """Digits 0 to 4095 of the metadata: language, length, bytes per character, lines per length.

    Only what equal texts have in common; the source is no dimension, as copies from two sources would be parted by it.
    """
    size, chars = F.octet_length(text) + 1, F.char_length(text) + 1
    top = F.lit(DIGIT - 1)
    out = [F.floor(F.log2(size) * 100), F.floor((size / chars - 1) * (DIGIT / 3.0)), F.floor(F.log2((F.regexp_count(text, F.lit("\n")) + 1) / size + 1) * DIGIT)]
    out = [F.greatest(F.lit(0), F.least(x, top)).cast("int") for x in out]
    if "lang" in docs.columns:
        out.append(F.pmod(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit(""))), F.lit(DIGIT)).cast("int"))
    return out


def _level(points: DataFrame, nodes: list[Node], n_dims: int, tolerance: float, whole: float, target: float) -> dict[int, tuple[int, list[int]]]:
    """For each node with more than one leaf, the dimension and the digits below which rows go left."""
    spark = points.sparkSession
    live = {n.name: n for n in nodes if n.leaves > 1}
    if not live:
        return {}
    spread = points.groupBy("_node").agg(
        F.sum("size").alias("bytes"), *[(F.max(f"_d{i}") - F.min(f"_d{i}")).alias(f"w{i}") for i in range(n_dims)]
    ).collect()  # one row per node
    wanted, total = {}, {}
    for r in spread:
        node = live.get(r["_node"])
        if node is None:
            continue
        node.dimension = max(range(n_dims), key=lambda i: r[f"w{i}"])
        total[node.name] = r["bytes"]
        wanted[node.name] = r["bytes"] * (node.leaves // 2) / node.leaves
    searching = [n for n in live.values() if n.name in total]
    left_rows = None
    while searching:
        depth = len(searching[0].cut)
        state = _local(spark, [(n.name, n.dimension, n.cut, float(wanted[n.name])) for n in searching], "_node, _dim, _cut, _wanted")  # nodes of the level
        digit = F.element_at(F.array(*[f"_d{i}" for i in range(n_dims)]), F.col("_dim") + 1)
        path = F.concat(F.array(digit), F.col("_digits"))
        inside = points.join(state, "_node").withColumn("_path", path)
        if depth:
            inside = inside.where(F.slice("_path", 1, depth) == F.col("_cut"))
        # few rows: the rest of the text's digits at once, and those of the key's; never both, as a group of equal texts ends between them
        end = TEXT_END if depth < TEXT_END else DEPTH
        upto_digit = end if left_rows is not None and left_rows <= FEW_ROWS else depth + 1
        step = F.slice("_path", depth + 1, upto_digit - depth)
        sums = inside.groupBy("_node", step.alias("_step")).agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"), F.first("_wanted").alias("_wanted"))
        upto = F.sum("_bytes").over(Window.partitionBy("_node").orderBy("_step"))
        crossing = sums.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_bytes") < F.col("_wanted")))
        found = {r["_node"]: r for r in crossing.select("_node", "_step", "_bytes", "_upto", "_rows").collect()}  # one row per node
        still, left_rows = [], 0
        for n in searching:
            r = found.get(n.name)
            if r is None:
                continue
            below = r["_upto"] - r["_bytes"]
            n.cut += r["_step"]
            light = tolerance if len(n.cut) < TEXT_END else whole
            if r["_bytes"] <= light * target or len(n.cut) == DEPTH:
                if wanted[n.name] - below > r["_upto"] - wanted[n.name]:
                    n.cut[-1] += 1
            else:
                wanted[n.name] -= below
                left_rows = max(left_rows, r["_rows"])
                still.append(n)
        searching = still
    return {n.name: (n.dimension, n.cut) for n in live.values() if n.name in total}


def shard(docs: DataFrame, n_shards: int, keys: list[str], tolerance: float = 0.002, whole: float = 0.05) -> DataFrame:
    """``keys``, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) of every row.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 is that of the bytes (null: of none).  Reads text, the
    keys, and lang where it is there; a null language is a value like others.  Repeated rows are placed
    each.  Shards differ in bytes by about ``tolerance`` per level of the tree and by single rows that are larger; a group
    of equal texts of up to ``whole`` of a shard goes to one side, the nearer to even one, a heavier one is cut by its
    rows' keys.  Ties between equal places keep their rows together; texts of any length are one row.
    """
    words = F.coalesce("text", F.lit(""))
    text = words.cast("binary")
    size = (F.octet_length(words) + 8).cast("long")
    dims = dimensions(docs, words)
    digits = F.array(*_digits(F.xxhash64(text), TEXT_DIGITS), *_digits(F.xxhash64(*keys, F.lit(7)), KEY_DIGITS))
    points = docs.select(*keys, size.alias("size"), F.crc32(text).alias("text_crc32"), *[d.alias(f"_d{i}") for i, d in enumerate(dims)], digits.alias("_digits"))
    points = stored(points, "points")
    told = points.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    target = (told["bytes"] or 0) / n_shards
    nodes = [Node(0, 0, n_shards)]
    placed = points.withColumn("_node", F.lit(0))
    while any(n.leaves > 1 for n in nodes):
        cuts = _level(placed, nodes, len(dims), tolerance, whole, target)
        after, rows = [], []
        for n in nodes:
            left = n.leaves // 2
            if n.leaves == 1:
                rows.append((n.name, 0, [DIGIT + 1], len(after), len(after)))
                after.append(Node(len(after), n.first, 1))
                continue
            dimension, cut = cuts.get(n.name, (0, [DIGIT + 1]))
            rows.append((n.name, dimension, cut, len(after), len(after) + 1))
            after += [Node(len(after), n.first, left), Node(len(after) + 1, n.first + left, n.leaves - left)]
        state = _local(docs.sparkSession, rows, "_node, _dim, _cut, _left, _right")  # nodes of the level
        digit = F.element_at(F.array(*[f"_d{i}" for i in range(len(dims))]), F.col("_dim") + 1)
        path = F.slice(F.concat(F.array(digit), F.col("_digits")), F.lit(1), F.size("_cut"))
        moved = placed.join(state, "_node").withColumn("_node", F.when(path < F.col("_cut"), F.col("_left")).otherwise(F.col("_right")))
        placed = moved.drop("_dim", "_cut", "_left", "_right")
        nodes = after
    named = ranked(placed.withColumnRenamed("_node", "shard"), ["shard"], [F.col(k) for k in keys] + [F.col("text_crc32")], [F.col(k) for k in keys], "slot", bucket_count(told["n"]))
    return named.select(*keys, "size", "text_crc32", "shard", "slot")
