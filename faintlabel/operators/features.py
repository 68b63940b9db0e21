"""Feature columns: assembly, subsets, checks, moments and the long form.

A feature set is *wide* (a list of numeric column names), *packed* (one ARRAY<DOUBLE> or vector column) or *entries* (a
column of ascending indices and one of the values there; the other features are 0).  Wide sets let Catalyst prune and
vectorise; packed sets suit hundreds of dimensions; entries cost what a row stores, whatever the width.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import ElementwiseProduct, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlabel.functions.scalar import rounded


@dataclass(frozen=True)
class FeatureSet:
    """Where the features of a row are: ``columns`` if wide, ``packed`` otherwise, the indices with ``values`` for entries;
    ``size`` dimensions."""

    size: int
    columns: tuple[str, ...] = ()
    packed: str = ""
    values: str = ""

    @staticmethod
    def wide(columns: Sequence[str]) -> FeatureSet:
        return FeatureSet(len(columns), tuple(columns))

    @staticmethod
    def in_column(name: str, size: int) -> FeatureSet:
        return FeatureSet(size, (), name)

    @staticmethod
    def entries(indices: str, values: str, size: int) -> FeatureSet:
        return FeatureSet(size, (), indices, values)

    @property
    def is_wide(self) -> bool:
        return bool(self.columns)

    @property
    def is_entries(self) -> bool:
        return bool(self.values)

    @property
    def inputs(self) -> list[str]:
        """Columns a scan must deliver."""
        return list(self.columns) if self.is_wide else [self.packed, self.values] if self.is_entries else [self.packed]

    def is_vector(self, df: DataFrame) -> bool:
        return not self.is_wide and not self.is_entries and isinstance(df.schema[self.packed].dataType, VectorUDT)

    def stored(self, df: DataFrame) -> Column | None:
        """ARRAY<STRUCT<feature, value>> of what a sparse row stores; None for the other forms."""
        if self.is_entries:
            return F.zip_with(self.packed, self.values, lambda i, x: F.struct(i.cast("int").alias("feature"), x.cast("double").alias("value")))
        return sparse_entries(self.packed) if self.is_vector(df) else None

    def listed(self, df: DataFrame) -> Column:
        """ARRAY<STRUCT<feature, value>> of every form; zeros may be left out."""
        stored = self.stored(df)
        if stored is not None:
            return stored
        return F.transform(self.array(df), lambda x, i: F.named_struct(F.lit("feature"), i, F.lit("value"), x.cast("double")))

    def array(self, df: DataFrame) -> Column:
        """Dense ARRAY<DOUBLE> of all features."""
        if self.is_wide:
            return F.array(*[F.col(c).cast("double") for c in self.columns])
        if self.is_entries:
            return laid_out(F.col(self.packed), F.col(self.values), self.size)
        return vector_to_array(F.col(self.packed)) if self.is_vector(df) else F.col(self.packed)

    def scalars(self, df: DataFrame) -> list[Column]:
        """One double expression per feature."""
        if self.is_wide:
            return [F.col(c).cast("double") for c in self.columns]
        a = self.array(df)
        return [F.element_at(a, i + 1) for i in range(self.size)]

    def at(self, df: DataFrame, index: int | Column) -> Column:
        """The value of one feature, the index fixed or given by a column."""
        if self.is_wide and isinstance(index, int):
            return F.col(self.columns[index]).cast("double")
        i = F.lit(index) if isinstance(index, int) else index
        stored = self.stored(df)
        if stored is not None:
            return F.coalesce(F.get(F.filter(stored, lambda e: e["feature"] == i), F.lit(0))["value"], F.lit(0.0))
        return F.element_at(self.array(df), (i + 1).cast("int"))


def feature_columns(df: DataFrame, leading: int = 4) -> list[str]:
    """All columns after the leading ones are features."""
    return df.columns[leading:]


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str], out: str = "features") -> DataFrame:
    """Vector column from numeric columns; unneeded columns are dropped first, since no rule prunes inside a vector."""
    return (
        VectorAssembler(inputCols=list(columns), outputCol=out).transform(df.select(*keep, *columns)).drop(*columns)
    )


def subset(
    df: DataFrame, indices: Sequence[int], col: str = "features", sparse: bool = False, size: int | None = None
) -> DataFrame:
    """Vector restricted to the given indices: in the given order, or with the old width and all else zero.

    Both forms stay in the JVM and touch the stored entries of a sparse vector only.
    """
    if not sparse:
        sliced = VectorSlicer(inputCol=col, outputCol="_sliced", indices=list(indices)).transform(df)
        return sliced.drop(col).withColumnRenamed("_sliced", col)
    if size is None:
        raise ValueError("the sparse form needs the width of the vectors")
    wanted = set(indices)
    mask = Vectors.dense([1.0 if i in wanted else 0.0 for i in range(size)])
    masked = ElementwiseProduct(scalingVec=mask, inputCol=col, outputCol="_masked").transform(df)
    return masked.drop(col).withColumnRenamed("_masked", col)


def subset_per_bag(
    bags: DataFrame, lists: DataFrame, features: FeatureSet, out: str = "features", n_bags: int | None = None
) -> DataFrame:
    """Each bag gets its own feature list (``lists``: bag_id, indices ARRAY<INT>).

    The list table has one row per bag; whether it is broadcast is left to its size.  A bag without a list fails the
    job, and with ``n_bags`` the number of lists is checked up front.
    """
    if n_bags is not None:
        n_lists = lists.select("bag_id").distinct().count()
        if n_lists != n_bags:
            raise ValueError(f"{n_bags} bags but {n_lists} feature lists")
    packed = bags.withColumn("_all", features.array(bags)).drop(*features.inputs)
    picked = F.transform("indices", lambda i: F.element_at(F.col("_all"), i + 1))
    missing = F.raise_error(F.concat(F.lit("no feature list for bag "), F.col("bag_id").cast("string")))
    return (
        packed.join(lists, "bag_id", "left")
        .withColumn(out, F.when(F.col("indices").isNull(), missing.cast("array<double>")).otherwise(picked))
        .drop("_all", "indices")
    )


def without_prefixes(names: Sequence[str], prefixes: Sequence[str]) -> list[int]:
    """Indices of the attribute names that start with none of the prefixes."""
    return [i for i, n in enumerate(names) if not n.startswith(tuple(prefixes))]


def named_features(names: DataFrame) -> DataFrame:
    """(feature, name): attribute names numbered from 0 in their order.

    Names are dealt to ranges by their first characters and numbered inside those, so no task holds all of them.
    """
    cut = names.select("name", F.substring("name", 1, 7).alias("_range"))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("name"))
    return cut.withColumn("_inside", inside).join(base, "_range").select((F.col("_base") + F.col("_inside") - 1).alias("feature"), "name")


def has_prefix(name: Column, prefixes: Sequence[str]) -> Column:
    """Whether an attribute name starts with one of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | name.startswith(p)
    return found


def discrete_report(df: DataFrame, features: FeatureSet, low: float = -128, high: float = 127) -> DataFrame:
    """Per feature: how many values are not whole, how many are outside [low, high].  One aggregate."""
    if features.is_wide:
        aggs = []
        for i, c in enumerate(features.scalars(df)):
            aggs += [
                F.count(F.when(c != F.floor(c), 1)).alias(f"w{i}"),
                F.count(F.when((c < low) | (c > high), 1)).alias(f"r{i}"),
            ]
        cells = F.array(
            *[
                F.struct(F.lit(i).alias("feature"), F.col(f"w{i}").alias("n_not_whole"), F.col(f"r{i}").alias("n_out_of_range"))
                for i in range(features.size)
            ]
        )
        return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    value = F.col("value")
    zero_is_fine = low <= 0 <= high
    entries = nonzero_long(df, features, []) if zero_is_fine else df.select(
        F.posexplode(features.array(df)).alias("feature", "value")
    )
    found = entries.groupBy("feature").agg(
        F.count(F.when(value != F.floor(value), 1)).alias("n_not_whole"),
        F.count(F.when((value < low) | (value > high), 1)).alias("n_out_of_range"),
    )
    every = df.sparkSession.range(features.size).select(F.col("id").cast("int").alias("feature"))
    return every.join(found, "feature", "left").na.fill(0)


def require_discrete(df: DataFrame, features: FeatureSet, low: float = -128, high: float = 127) -> None:
    """Raise if any feature value is not a whole number in range."""
    bad = (
        discrete_report(df, features, low, high)
        .agg(F.sum("n_not_whole").alias("w"), F.sum("n_out_of_range").alias("r"))
        .first()
    )
    if bad["w"] or bad["r"]:
        raise ValueError(f"ranking needs whole values in [{low}, {high}]: {bad['w']} not whole, {bad['r']} out of range")


def feature_std(df: DataFrame, features: FeatureSet) -> DataFrame:
    """Sample standard deviation and mean per feature: (feature, mean, std)."""
    if features.is_wide:
        scalars = features.scalars(df)
        aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(scalars)]
        aggs += [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(scalars)]
        cells = F.array(
            *[F.struct(F.lit(i).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i in range(features.size)]
        )
        return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    if features.is_vector(df):
        summary = df.agg(Summarizer.metrics("mean", "std").summary(F.col(features.packed)).alias("s"))
        pairs = F.arrays_zip(vector_to_array(F.col("s.mean")).alias("mean"), vector_to_array(F.col("s.std")).alias("std"))
        return summary.select(F.posexplode(pairs).alias("feature", "p")).select("feature", "p.mean", "p.std")
    return (
        df.select(F.posexplode(features.array(df)).alias("feature", "value"))
        .groupBy("feature")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )


ROW_MARK = -1  # pseudo feature that every row carries once


def nonzero_long(df: DataFrame, features: FeatureSet, keys: Sequence[str], mark_rows: bool = False) -> DataFrame:
    """(keys, feature, value) for the non-zero entries only.

    ``mark_rows`` adds one entry ``ROW_MARK`` per row, so that counts of entries and of rows need only one scan.

    Sparse vectors are exploded through their stored entries, so a row of a wide sparse table costs its non-zeros.
    Generation happens inside the map task; nothing is shuffled here.
    """
    if features.is_wide:
        entries = F.array(
            *[F.struct(F.lit(i).alias("feature"), c.alias("value")) for i, c in enumerate(features.scalars(df))]
        )
    elif (stored := features.stored(df)) is not None:
        entries = stored
    else:
        entries = F.transform(
            F.col(features.packed), lambda x, i: F.struct(i.alias("feature"), x.cast("double").alias("value"))
        )
    if mark_rows:
        mark = F.array(F.struct(F.lit(ROW_MARK).alias("feature"), F.lit(1.0).alias("value")))
        entries = F.concat(mark, entries)
    return (
        df.select(*keys, F.explode(entries).alias("_e"))
        .select(*keys, "_e.feature", "_e.value")
        .filter(F.col("value") != 0)
    )


def laid_out(indices: Column, values: Column, size: int) -> Column:
    """Dense ARRAY<DOUBLE> from ascending indices and the values there, in time of the width."""
    before = lambda k: F.coalesce(F.get(indices, k - 1), F.lit(-1))
    gap = lambda i, k: F.array_repeat(F.lit(0.0), (i - before(k) - 1).cast("int"))
    filled = F.flatten(F.transform(indices, lambda i, k: F.concat(gap(i, k), F.array(F.get(values, k).cast("double")))))
    rest = F.lit(size - 1) - F.coalesce(F.get(indices, F.size(indices) - 1), F.lit(-1))
    return F.concat(filled, F.array_repeat(F.lit(0.0), rest.cast("int")))


def sparse_entries(vector_col: str) -> Column:
    """ARRAY<STRUCT<feature, value>> of the stored entries of a vector column; dense rows give all entries."""
    v = F.unwrap_udt(F.col(vector_col))
    values = v["values"]
    index = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(values) - 1))
    return F.zip_with(index, values, lambda i, x: F.struct(i.alias("feature"), x.alias("value")))


def unpivot(df: DataFrame, features: FeatureSet, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """(keys, feature, value) for all entries, zeros included."""
    out = df.select(*keys, F.posexplode(features.array(df)).alias("feature", "value"))
    return out if digits is None else out.withColumn("value", rounded(F.col("value"), digits))
