"""Training and truth labels from class strings and detector counts.

All rules are column expressions, so both the filters and the needed columns reach the scan.  ``label`` is the
label a learner may see (1 positive, 0 unlabeled or negative), ``real_label`` the truth used in tests (-1 unknown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the input table.
BENIGN_CLASS = "playdrone_benign"
MALWARE_CLASS = "high_mal"
NOT_SCANNED = -1
UNKNOWN = -1.0
MIN_MALWARE = 10


def class_label(class_col: str = "class") -> Column:
    """0 for the benign class, 1 for the malware class, -1 for every other class."""
    c = F.col(class_col)
    return F.when(c == BENIGN_CLASS, 0.0).when(c == MALWARE_CLASS, 1.0).otherwise(UNKNOWN)


def count_label(max_benign: int, min_malware: int, count_col: str = "scannersCount") -> Column:
    """1 from ``min_malware`` on, else 0 up to ``max_benign``, else -1.  The first rule wins where ranges overlap."""
    n = F.col(count_col)
    return F.when(n >= min_malware, 1.0).when(n <= max_benign, 0.0).otherwise(UNKNOWN)


def truth_label(count_col: str = "scannersCount") -> Column:
    """Later label: 1 for ten or more detectors, 0 for none, -1 (unknown) in between or when not scanned."""
    n = F.col(count_col)
    return F.when(n >= MIN_MALWARE, 1.0).when(n == 0, 0.0).otherwise(UNKNOWN)


def _base_classes(df: DataFrame) -> DataFrame:
    return df.filter(F.col("class").isin(BENIGN_CLASS, MALWARE_CLASS))


def _scanned(df: DataFrame) -> DataFrame:
    return df.filter(F.col("scannersCount") != NOT_SCANNED)


def label_by_class(df: DataFrame) -> DataFrame:
    """Add the class label to every row; rows of other classes get -1."""
    return df.withColumn("label", class_label())


def base_set(df: DataFrame) -> DataFrame:
    """Rows of the two base classes, labeled by class."""
    return _base_classes(df).withColumn("label", class_label())


def label_by_threshold(df: DataFrame, max_benign: int, min_malware: int) -> DataFrame:
    """Scanned rows labeled by detector count; rows between the two limits are dropped."""
    return _scanned(df).withColumn("label", count_label(max_benign, min_malware)).filter(F.col("label") != UNKNOWN)


def label_2016(df: DataFrame) -> DataFrame:
    """Scanned rows with no detector (0) or at least ten (1)."""
    return label_by_threshold(df, 0, MIN_MALWARE)


def label_both_years(df: DataFrame) -> DataFrame:
    """Rows that have a class label and a known count label: ``label`` is the old one, ``real_label`` the new."""
    return (
        _base_classes(df)
        .withColumn("label", class_label())
        .withColumn("real_label", truth_label())
        .filter(F.col("real_label") != UNKNOWN)
    )


def label_highconf_rest(df: DataFrame) -> DataFrame:
    """Train on ten or more detectors against all the rest; the truth of counts 1 to 9 is unknown (-1)."""
    return (
        _scanned(df)
        .withColumn("label", count_label(MIN_MALWARE - 1, MIN_MALWARE))
        .withColumn("real_label", truth_label())
        .filter(F.col("label") != UNKNOWN)
    )


def temporal_holdout(df: DataFrame) -> DataFrame:
    """Rows that were benign by class but have more than nine detectors now; all positive."""
    return df.filter((F.col("class") == BENIGN_CLASS) & (F.col("scannersCount") >= MIN_MALWARE)).withColumn(
        "label", F.lit(1.0)
    )


def effective_label(df: DataFrame) -> Column:
    """Truth where the row carries one, else the observed label."""
    if "real_label" in df.columns:
        return F.coalesce(F.col("real_label"), F.col("label"))
    return F.col("label")


def is_changed() -> Column:
    """The observed label differs from the truth."""
    return F.col("real_label") != F.col("label")


def changed_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_changed())


def unchanged_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("real_label") == F.col("label"))


def known_truth(df: DataFrame) -> DataFrame:
    return df.filter(F.col("real_label") != UNKNOWN)


def relabel_to_truth(df: DataFrame) -> DataFrame:
    """Use the later label for training too."""
    return df.withColumn("label", F.col("real_label"))


def any_positive(df: DataFrame) -> Column:
    """Labeled positive, or positive in truth though hidden from the learner."""
    if "real_label" in df.columns:
        return (F.col("label") == 1) | F.coalesce(F.col("real_label") == 1, F.lit(False))
    return F.col("label") == 1


def class_counts(df: DataFrame) -> DataFrame:
    """Rows per observed label and, for rows that carry a truth, per real label, in one aggregate."""
    real = F.col("real_label") if "real_label" in df.columns else F.lit(None).cast("double")
    sides = F.array(
        F.struct(F.lit("label").alias("source"), F.col("label").cast("double").alias("value")),
        F.struct(F.lit("real_label").alias("source"), real.cast("double").alias("value")),
    )
    return (
        df.groupBy(F.col("label").cast("double").alias("label"), real.cast("double").alias("real_label"))
        .agg(F.count("*").alias("n"))
        .select("n", F.explode(sides).alias("s"))
        .filter(F.col("s.value").isNotNull())
        .groupBy("s.source", "s.value")
        .agg(F.sum("n").alias("n"))
    )


def changed_counts(df: DataFrame) -> DataFrame:
    """One row: how many labels moved between the two vintages, and in which direction."""
    moved = is_changed()
    return df.agg(
        F.count("*").alias("n"),
        F.sum(F.when(moved, 1).otherwise(0)).alias("n_changed"),
        F.sum(F.when(moved & (F.col("real_label") == 1), 1).otherwise(0)).alias("n_to_positive"),
    )


def union_roles(labeled: DataFrame, hidden: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """Bag union of three row roles; columns are matched by name."""
    return labeled.unionByName(hidden).unionByName(unlabeled)
