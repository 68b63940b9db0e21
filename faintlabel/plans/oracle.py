"""ANSI SQL that repeats the queries of ``queries.py`` on the same parquet tables (DuckDB dialect).

Each text is put together from common table expressions; all computed numbers are rounded to six digits on both sides.
"""

from __future__ import annotations

from faintlabel.plans.committees import TECHNIQUES

N_FEATURES = 10
N_BITS = 64
F_LIST = ", ".join(f"f{i}" for i in range(N_FEATURES))


def hash32(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


def unit(key: str, seed: int) -> str:
    return f"({hash32(key, seed)} / 4294967296.0::DOUBLE)"


def digest(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE"


# ---- common tables ------------------------------------------------------------------------------------------------

APPSEC = """
li AS (
  SELECT l_orderkey AS k, count(*) AS n_lines,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
    sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS n_a,
    sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS n_f,
    sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS n_bulk,
    sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS n_disc,
    sum(CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END) AS n_tax,
    sum(CASE WHEN l_extendedprice > 50000 THEN 1 ELSE 0 END) AS n_big
  FROM lineitem GROUP BY l_orderkey),
appsec AS (
  SELECT o_orderkey AS id, concat('fam', CAST(o_custkey % 40 AS VARCHAR)) AS family,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1
      ELSE greatest(0, coalesce(n_r, 0) * 4 - 3 + o_orderkey % 5 - 2) END AS INTEGER) AS "scannersCount",
    CASE WHEN o_orderstatus = 'P' THEN 'low_mal'
      WHEN coalesce(n_r, 0) + coalesce(n_f, 0) >= 5 THEN 'high_mal' ELSE 'playdrone_benign' END AS class,
    CAST(coalesce(n_lines, 0) AS INTEGER) AS f0, CAST(coalesce(n_r, 0) AS INTEGER) AS f1,
    CAST(coalesce(n_a, 0) AS INTEGER) AS f2, CAST(coalesce(n_f, 0) AS INTEGER) AS f3,
    CAST(coalesce(n_bulk, 0) AS INTEGER) AS f4, CAST(coalesce(n_disc, 0) AS INTEGER) AS f5,
    CAST(coalesce(n_tax, 0) AS INTEGER) AS f6, CAST(coalesce(n_big, 0) AS INTEGER) AS f7,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS f8, CAST(month(o_orderdate) AS INTEGER) AS f9
  FROM orders LEFT JOIN li ON k = o_orderkey)"""

CLASS_LABEL = "CASE class WHEN 'playdrone_benign' THEN 0.0::DOUBLE WHEN 'high_mal' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
TRUTH = 'CASE WHEN "scannersCount" >= 10 THEN 1.0::DOUBLE WHEN "scannersCount" = 0 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END'


def count_label(max_benign: int, min_malware: int) -> str:
    return (
        f'CASE WHEN "scannersCount" >= {min_malware} THEN 1.0::DOUBLE '
        f'WHEN "scannersCount" <= {max_benign} THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END'
    )


# Scanned rows with no detector or at least ten.
LAB = f"""{APPSEC},
lab AS (
  SELECT * FROM (SELECT id, family, {count_label(0, 10)} AS label, {F_LIST} FROM appsec WHERE "scannersCount" <> -1)
  WHERE label <> -1.0)"""

# Rows with a label of each year.
BOTH = f"""{APPSEC},
lab AS (
  SELECT * FROM (
    SELECT id, {CLASS_LABEL} AS label, {TRUTH} AS real_label, {F_LIST}
    FROM appsec WHERE class IN ('playdrone_benign', 'high_mal'))
  WHERE real_label <> -1.0)"""

BITS = """
bits AS (
  SELECT vec_id AS id, label AS grp, CASE WHEN label <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
    [CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN embedding] AS features
  FROM embeddings)"""

VECTORS_LONG = """
vlong AS (
  SELECT vec_id AS id, unnest(range(64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def long_form(source: str, name: str = "long", extra: str = "label") -> str:
    """(id, extra, feature, value) from the wide feature columns."""
    cells = " UNION ALL ".join(
        f"SELECT id, {extra}, {i} AS feature, CAST(f{i} AS DOUBLE) AS value FROM {source}" for i in range(N_FEATURES)
    )
    return f"{name} AS ({cells})"


def bits_long(source: str = "bits", name: str = "long", extra: str = "label") -> str:
    return f"{name} AS (SELECT id, {extra}, unnest(range({N_BITS})) AS feature, unnest(features) AS value FROM {source})"


# Sign bits with class 3 as the minority.
BIT_CLASSES = f"""{BITS},
lab AS (SELECT id, CASE WHEN grp = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, features FROM bits)"""


def bags(seed: int = 7, source: str = "lab") -> str:
    """Chunks of the majority in hash order; ``bagged`` repeats the minority in every bag."""
    return f"""
sizes AS (SELECT count(*) FILTER (label = 1) AS n_min, count(*) FILTER (label <> 1) AS n_maj FROM {source}),
chunk AS (
  SELECT id, CAST((row_number() OVER (ORDER BY {digest('id', seed)}, id) - 1) // (SELECT n_min FROM sizes) AS BIGINT) AS bag_id
  FROM {source} WHERE label <> 1),
bag_ids AS (SELECT DISTINCT bag_id FROM chunk),
bagged AS (
  SELECT bag_id, s.* FROM {source} s JOIN chunk USING (id)
  UNION ALL SELECT bag_id, s.* FROM {source} s CROSS JOIN bag_ids WHERE label = 1)"""


def given(size: int = N_FEATURES, name: str = "w") -> str:
    return f"{name} AS (SELECT j AS feature, sin(j + 1) / 10 AS w FROM range({size}) t(j))"


def dot(prefix: str = "", bias: str = "0.0::DOUBLE", weight=lambda j: f"sin({j} + 1) / 10") -> str:
    return " + ".join([bias, *[f"{prefix}f{j} * ({weight(j)})" for j in range(N_FEATURES)]])


def sigmoid(m: str) -> str:
    return f"(CASE WHEN {m} >= 0 THEN 1 / (1 + exp(-({m}))) ELSE exp({m}) / (1 + exp({m})) END)"


def softplus_neg(m: str) -> str:
    return f"(greatest(-({m}), 0) + ln(1 + exp(-abs({m}))))"


ORACLE: dict[str, str] = {}


def put(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes}\n{select}"


# ---- sources and sinks --------------------------------------------------------------------------------------------

put("scan_appsec", APPSEC, f'SELECT id, family, "scannersCount", class, {F_LIST} FROM appsec')
put(
    "arff_sparse",
    f"{BITS}, {bits_long()}",
    "SELECT label, CAST(feature + 1 AS BIGINT) AS feature, CAST(count(*) AS BIGINT) AS n, sum(value) AS total "
    "FROM long GROUP BY 1, 2",
)
put(
    "arff_dense",
    APPSEC,
    f"SELECT id, CASE WHEN class = 'high_mal' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, {F_LIST} "
    "FROM appsec WHERE class <> 'low_mal'",
)
put(
    "genome_scan",
    LAB,
    f"SELECT family, family || '-' || CAST(id AS VARCHAR) AS member, label, {F_LIST} FROM lab WHERE label = 1",
)
put(
    "libsvm_roundtrip",
    f"{LAB}, f AS (SELECT *, {hash32('id', 11)} AS h FROM lab), parts AS (SELECT k, unnest(range(k)) AS i FROM (VALUES (3), (5)) t(k))",
    f"""SELECT 'fold-' || CAST(i + 1 AS VARCHAR) || '-of-' || CAST(k AS VARCHAR) || '_' || CASE WHEN h % k = i THEN 'test' ELSE 'train' END AS part,
      id, label, {F_LIST} FROM f CROSS JOIN parts""",
)
put(
    "save_predictions",
    f"{LAB}, p AS (SELECT label, CASE WHEN {sigmoid('m')} > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction "
    f"FROM (SELECT label, {dot()} AS m FROM lab))",
    "SELECT prediction, label, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2",
)
put(
    "model_roundtrip",
    f"{LAB}, {long_form('lab')}",
    f"""SELECT CAST(feature AS BIGINT) AS feature, {r6('avg(value)')} AS weight, 0.25::DOUBLE AS intercept,
      CAST(10 AS BIGINT) AS num_features, CAST(2 AS BIGINT) AS num_classes, 0.5::DOUBLE AS threshold FROM long GROUP BY feature""",
)
put(
    "experiment_results",
    LAB,
    """SELECT run_id, 'counts' AS experiment, CAST(CAST(label AS INTEGER) AS VARCHAR) AS label, CAST(fold AS BIGINT) AS fold,
      'none' AS model, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value
FROM lab CROSS JOIN (VALUES ('run', 0), ('again', 1)) t(run_id, fold) GROUP BY label, run_id, fold""",
)

# ---- labels and filters -------------------------------------------------------------------------------------------

put("label_by_class", APPSEC, f"SELECT id, {CLASS_LABEL} AS label FROM appsec")
put(
    "label_by_threshold",
    APPSEC,
    f'SELECT * FROM (SELECT id, {count_label(4, 10)} AS label FROM appsec WHERE "scannersCount" <> -1) WHERE label <> -1.0',
)
put("label_2016", LAB, "SELECT id, label FROM lab")
put("label_both_years", BOTH, "SELECT id, label, real_label FROM lab")
put("relabel_to_truth", BOTH, "SELECT id, real_label AS label, real_label FROM lab")
put(
    "label_report",
    f"""{BOTH}, told AS (
  SELECT 'label' AS col, label AS y FROM lab UNION ALL SELECT 'real_label', real_label FROM lab UNION ALL SELECT 'shifted', label + 1 FROM lab
  UNION ALL SELECT 'only_positive', CASE WHEN label = 1 THEN 1.0::DOUBLE END FROM lab UNION ALL SELECT 'doubtful', real_label * 2 - 1 FROM lab),
counted AS (SELECT col, count(y) AS n, count(*) FILTER (y NOT IN (0, 1)) AS n_bad, count(*) FILTER (y = 0) AS n_unlabeled FROM told GROUP BY col)""",
    """SELECT col AS "column", n, n_bad, n_unlabeled,
  CASE WHEN n_bad > 0 THEN 'labels other than 0 and 1' WHEN n_unlabeled = 0 THEN 'no unlabeled rows' ELSE '' END AS problem FROM counted""",
)
put(
    "shape_report",
    "v AS (SELECT CASE WHEN vec_id % 97 = 0 THEN 60 WHEN vec_id % 101 = 0 THEN NULL ELSE len(embedding) END AS size FROM embeddings)",
    """SELECT CASE WHEN size IS NULL THEN 'no features' WHEN size <> 64 THEN 'wrong size' ELSE 'fits' END AS problem,
  CAST(coalesce(size, -1) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL""",
)
put(
    "label_highconf_rest",
    APPSEC,
    f'SELECT id, {count_label(9, 10)} AS label, {TRUTH} AS real_label FROM appsec WHERE "scannersCount" <> -1',
)
put(
    "temporal_holdout",
    APPSEC,
    f"""SELECT id, 'base' AS part, {CLASS_LABEL} AS label FROM appsec WHERE class IN ('playdrone_benign', 'high_mal')
UNION ALL SELECT id, 'temporal', 1.0::DOUBLE FROM appsec WHERE class = 'playdrone_benign' AND "scannersCount" > 9""",
)
put("changed_labels", BOTH, "SELECT id, label, real_label FROM lab WHERE label <> real_label")
put(
    "changed_label_counts",
    BOTH,
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (label <> real_label) AS BIGINT) AS n_changed,
      CAST(count(*) FILTER (label <> real_label AND real_label = 1) AS BIGINT) AS n_to_positive FROM lab""",
)
put(
    "class_counts",
    "d AS (SELECT CAST(toxic AS DOUBLE) AS real_label FROM documents LEFT JOIN labels USING (doc_id))",
    """SELECT 'label' AS source, coalesce(real_label, 0.0::DOUBLE) AS value, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 2
UNION ALL SELECT 'real_label', real_label, CAST(count(*) AS BIGINT) FROM d WHERE real_label IS NOT NULL GROUP BY 2""",
)


def noise(level: float, share: float, seed: int = 11) -> str:
    """Rows with their role: 1 labeled, 0 unlabeled, NULL dropped."""
    return f"""
cut AS (SELECT {share}::DOUBLE AS a, {level}::DOUBLE * count(*) FILTER (label = 0) / (1 - {level}::DOUBLE) / count(*) FILTER (label = 1) AS h FROM lab),
noisy AS (
  SELECT * EXCLUDE (label, u), label AS truth,
    CASE WHEN label = 0 THEN 0.0::DOUBLE WHEN u < (SELECT a FROM cut) THEN 1.0::DOUBLE
      WHEN u < (SELECT a + h FROM cut) THEN 0.0::DOUBLE END AS label
  FROM (SELECT *, {unit('id', seed)} AS u FROM lab)),
injected AS (
  SELECT * EXCLUDE (truth), CASE WHEN truth = 1 AND label = 0 THEN 1.0::DOUBLE END AS real_label FROM noisy WHERE label IS NOT NULL)"""


put(
    "union_roles",
    f"{LAB}, {noise(0.01, 0.5)}",
    """SELECT id, label, real_label, CASE WHEN label = 1 THEN 'labeled' WHEN real_label = 1 THEN 'hidden' ELSE 'unlabeled' END AS role
FROM injected""",
)

# ---- features -----------------------------------------------------------------------------------------------------

put("feature_assemble", f"{APPSEC}, {long_form('appsec', extra='class')}", "SELECT id, CAST(feature AS BIGINT) AS feature, value FROM long")
put(
    "feature_subset",
    f"{APPSEC}, {long_form('appsec', extra='class')}",
    """SELECT 'dense' AS form, id, CAST(CASE feature WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS feature, value
FROM long WHERE feature IN (7, 2, 5)
UNION ALL SELECT 'sparse', id, CAST(feature AS BIGINT), CASE WHEN feature IN (7, 2, 5) THEN value ELSE 0.0::DOUBLE END FROM long""",
)
_pick = "[" + ", ".join(f"CAST(f{i} AS DOUBLE)" for i in range(N_FEATURES)) + "]"
put(
    "feature_subset_per_bag",
    f"{LAB}, {bags()}",
    f"""SELECT bag_id, id, {_pick}[bag_id % 10 + 1] AS x0, {_pick}[(bag_id + 3) % 10 + 1] AS x1, {_pick}[(bag_id + 6) % 10 + 1] AS x2
FROM bagged""",
)
put(
    "feature_prefix_filter",
    "names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS feature FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand IS NOT NULL))",
    "SELECT CAST(feature AS BIGINT) AS feature, name FROM names WHERE NOT starts_with(name, 'Brand#1') AND NOT starts_with(name, 'Brand#3')",
)
put(
    "discrete_check",
    f"{APPSEC}, {long_form('appsec', extra='class')}, {VECTORS_LONG}",
    """SELECT 'counts' AS source, CAST(feature AS BIGINT) AS feature, CAST(count(*) FILTER (value <> floor(value)) AS BIGINT) AS n_not_whole,
  CAST(count(*) FILTER (value < 0 OR value > 9) AS BIGINT) AS n_out_of_range FROM long GROUP BY feature
UNION ALL SELECT 'vectors', CAST(feature AS BIGINT), CAST(count(*) FILTER (value <> floor(value)) AS BIGINT),
  CAST(count(*) FILTER (value < -128 OR value > 127) AS BIGINT) FROM vlong GROUP BY feature""",
)
put(
    "feature_std",
    f"{LAB}, {long_form('lab')}, {VECTORS_LONG}",
    f"""SELECT 'counts' AS source, CAST(feature AS BIGINT) AS feature, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std FROM long GROUP BY feature
UNION ALL SELECT 'vectors', CAST(feature AS BIGINT), {r6('avg(value)')}, {r6('stddev_samp(value)')} FROM vlong GROUP BY feature""",
)

# ---- sampling, folds, bags ----------------------------------------------------------------------------------------

put("hash_sample", APPSEC, f"SELECT id FROM appsec WHERE {unit('id', 11)} < 0.05")
put("hash_split", APPSEC, f"SELECT id, CAST(CASE WHEN {unit('id', 11)} < 0.67 THEN 0 ELSE 1 END AS BIGINT) AS split FROM appsec")
put("kfold_assign", APPSEC, f"SELECT id, {hash32('id', 11)} % 5 AS fold FROM appsec")
put("inject_noise", f"{LAB}, {noise(0.02, 0.5)}", "SELECT id, label, real_label FROM injected")
put(
    "undersample",
    f"""{LAB}, f AS (SELECT id, label, {hash32('id', 11)} % 3 AS fold, {unit('id', 11)} AS u FROM lab),
rate AS (SELECT t.i AS train_fold, count(*) FILTER (label = 1) / CAST(count(*) FILTER (label = 0) AS DOUBLE) AS q
  FROM f JOIN range(3) t(i) ON fold <> t.i GROUP BY t.i)""",
    "SELECT id, label, fold, train_fold FROM f JOIN rate ON fold <> train_fold WHERE label = 1 OR u < least(q, 1.0)",
)
put("balanced_bags", f"{LAB}, {bags()}", "SELECT bag_id, id, label FROM bagged")
put(
    "bag_dropping",
    f"""{LAB}, {bags()},
kept AS (SELECT bag_id FROM (SELECT bag_id, row_number() OVER (ORDER BY {digest('bag_id', 7)}, bag_id) AS r, count(*) OVER () AS n FROM bag_ids)
  WHERE r <= floor(0.5 * n))""",
    "SELECT bag_id, id, label FROM bagged WHERE bag_id IN (SELECT bag_id FROM kept)",
)
put(
    "family_one_shot",
    f"""{LAB},
half AS (SELECT id, family, {unit('id', 7)} < 0.5 AS train, {digest('id', 7)} AS h FROM lab WHERE label = 1),
ranked AS (SELECT id, row_number() OVER (PARTITION BY family ORDER BY h, id) AS r FROM half WHERE train),
pos AS (SELECT half.id, family, CASE WHEN NOT train THEN 'test' WHEN r = 1 THEN 'labeled' ELSE 'hidden' END AS role
  FROM half LEFT JOIN ranked USING (id))""",
    f"""SELECT id, family, role, CASE WHEN role = 'hidden' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label,
  CASE WHEN role = 'hidden' THEN 1.0::DOUBLE END AS real_label FROM pos
UNION ALL SELECT id, family, 'benign', 0.0::DOUBLE, NULL FROM lab WHERE label = 0 AND {unit('id', 11)} < 0.01""",
)
put(
    "random_features",
    f"{BITS}, {bits_long()}, seen AS (SELECT DISTINCT feature FROM long WHERE value <> 0)",
    f"""SELECT CAST(rank AS BIGINT) AS rank, CAST(feature AS BIGINT) AS feature
FROM (SELECT feature, row_number() OVER (ORDER BY {digest('feature', 7)}, feature) AS rank FROM seen) WHERE rank <= 12""",
)

# ---- ranking ------------------------------------------------------------------------------------------------------


def relevance(source: str = "long", name: str = "rel", key: str | None = None) -> str:
    """Mutual information with the label from the probabilities of the cells."""
    k = f"{key}, " if key else ""
    over = f"PARTITION BY {key}, " if key else "PARTITION BY "
    return f"""
{name}_c AS (SELECT {k}feature, value, label, count(*) AS n FROM {source} GROUP BY ALL),
{name}_p AS (
  SELECT {k}feature, CAST(n AS DOUBLE) AS n, sum(n) OVER ({over}feature, value) AS nx, sum(n) OVER ({over}feature, label) AS ny,
    sum(n) OVER ({over}feature) AS nn FROM {name}_c),
{name} AS (SELECT {k}feature, greatest(sum(n / nn * log2(n * nn / (nx * ny))), 0) AS mi FROM {name}_p GROUP BY ALL)"""


def redundancy(selected: str, name: str, source: str = "long") -> str:
    """I(X;Z) and I(X;Z|Y) with the feature that ``selected`` (a scalar query) names."""
    return f"""
{name}_z AS (SELECT id, value AS z FROM {source} WHERE feature = ({selected})),
{name}_c AS (SELECT feature, value AS x, z, label AS y, CAST(count(*) AS DOUBLE) AS n FROM {source} JOIN {name}_z USING (id) GROUP BY ALL),
{name}_xz AS (SELECT feature, x, z, sum(n) AS n FROM {name}_c GROUP BY ALL),
{name}_mi AS (
  SELECT feature, greatest(sum(n / nn * log2(n * nn / (nx * nz))), 0) AS mi FROM (
    SELECT feature, n, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, z) AS nz,
      sum(n) OVER (PARTITION BY feature) AS nn FROM {name}_xz) GROUP BY feature),
{name}_cmi AS (
  SELECT feature, greatest(sum(n / nn * log2(n * ny / (nxy * nzy))), 0) AS cmi FROM (
    SELECT feature, n, sum(n) OVER (PARTITION BY feature, x, y) AS nxy, sum(n) OVER (PARTITION BY feature, z, y) AS nzy,
      sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM {name}_c) GROUP BY feature),
{name} AS (SELECT feature, mi, cmi FROM {name}_mi JOIN {name}_cmi USING (feature))"""


put(
    "contingency",
    f"{LAB}, {long_form('lab')}",
    "SELECT CAST(feature AS BIGINT) AS feature, value, label, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY feature, value, label",
)
put("mi_relevance", f"{LAB}, {long_form('lab')}, {relevance()}", f"SELECT CAST(feature AS BIGINT) AS feature, {r6('mi')} AS mi FROM rel")
put("mi_relevance_sparse", f"{BITS}, {bits_long()}, {relevance()}", f"SELECT CAST(feature AS BIGINT) AS feature, {r6('mi')} AS mi FROM rel")
put(
    "mi_redundancy",
    f"{LAB}, {long_form('lab')}, {redundancy('1', 'red')}",
    f"SELECT CAST(feature AS BIGINT) AS feature, {r6('mi')} AS mi, {r6('cmi')} AS cmi FROM red",
)


def top(source: str, score: str, k: int) -> str:
    return f"""SELECT CAST(rank AS BIGINT) AS rank, CAST(feature AS BIGINT) AS feature, {r6('score')} AS score FROM (
  SELECT feature, {score} AS score, row_number() OVER (ORDER BY round({score}, 12) DESC, feature) AS rank FROM {source}) WHERE rank <= {k}"""


put("mim_topk", f"{BITS}, {bits_long()}, {relevance()}", top("rel", "mi", 10))

# Scores after ``step`` picks: rel, and of I(X;Z) and I(X;Z|Y) with the picks Z the sums (m, c), the sum of what the first
# exceeds the second by (e, not below 0 each) and the most of it (x, not below 0).
CRITERIA = {
    "mifs": "rel - m",
    "jmi": "rel - (m - c) / step",
    "mrmr": "rel - m / step",
    "icap": "rel - e",
    "cmim": "rel - x",
    "if": "rel - (m - c)",
}
PAIRS = """
pc AS (SELECT a.feature, b.feature AS other, a.value AS x, b.value AS z, a.label AS y, CAST(count(*) AS DOUBLE) AS n
  FROM long a JOIN long b USING (id) WHERE a.feature <> b.feature GROUP BY ALL),
pm AS (SELECT feature, other, greatest(sum(n / nn * log2(n * nn / (nx * nz))), 0) AS mi FROM (
  SELECT feature, other, n, sum(n) OVER (PARTITION BY feature, other, x) AS nx, sum(n) OVER (PARTITION BY feature, other, z) AS nz,
    sum(n) OVER (PARTITION BY feature, other) AS nn FROM (SELECT feature, other, x, z, sum(n) AS n FROM pc GROUP BY ALL)) GROUP BY ALL),
py AS (SELECT feature, other, greatest(sum(n / nn * log2(n * ny / (nxy * nzy))), 0) AS cmi FROM (
  SELECT feature, other, n, sum(n) OVER (PARTITION BY feature, other, x, y) AS nxy, sum(n) OVER (PARTITION BY feature, other, z, y) AS nzy,
    sum(n) OVER (PARTITION BY feature, other, y) AS ny, sum(n) OVER (PARTITION BY feature, other) AS nn FROM pc) GROUP BY ALL),
pairs AS MATERIALIZED (SELECT feature, other, mi, cmi FROM pm JOIN py USING (feature, other))"""


def greedy(score: str) -> str:
    """All ranks: each step adds the pairs with the best feature left to the sums of the others."""
    return f"""RECURSIVE {BITS.lstrip()}, {bits_long()}, {relevance()}, {PAIRS},
it(step, feature, rel, m, c, e, x, score) AS (
  SELECT 0, feature, mi, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, mi FROM rel
  UNION ALL
  SELECT *, {score} FROM (
    SELECT step + 1 AS step, t.feature, rel, m + mi AS m, c + cmi AS c, e + greatest(mi - cmi, 0) AS e, greatest(x, mi - cmi) AS x
    FROM (SELECT *, first_value(feature) OVER (ORDER BY round(score, 12) DESC, feature) AS best FROM it) t
    JOIN pairs p ON p.feature = t.feature AND p.other = t.best))"""


for _name, _score in CRITERIA.items():
    for _query in (f"rank_{_name}", *(["rank_cmim_lazy"] if _name == "cmim" else [])):
        put(
            _query,
            greedy(_score),
            f"""SELECT CAST(step + 1 AS BIGINT) AS rank, CAST(feature AS BIGINT) AS feature, {r6('score')} AS score
FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(score, 12) DESC, feature) AS place FROM it) WHERE place = 1""",
        )

_bag_rel = f"{BIT_CLASSES}, {bags()}, {bits_long('bagged', extra='bag_id, label')}, {relevance(key='bag_id')}"
put(
    "merged_ranking",
    f"{_bag_rel}, merged AS (SELECT feature, sum(abs(mi)) AS score FROM rel GROUP BY feature)",
    top("merged", "score", 10),
)
put(
    "topk_per_bag",
    f"""{_bag_rel},
ranked AS (SELECT bag_id, feature, mi, row_number() OVER (PARTITION BY bag_id ORDER BY round(abs(mi), 12) DESC, feature) AS rank FROM rel)""",
    f"SELECT bag_id, CAST(rank AS BIGINT) AS rank, CAST(feature AS BIGINT) AS feature, {r6('mi')} AS score FROM ranked WHERE rank <= 5",
)


def svm_recursion(source: str, iterations: int, values: list[str] | None = None) -> str:
    """The subgradient schedule to the end: rate 1/sqrt(i), L2 shrink of .01, from zero weights; stop after ``iterations``
    or when a step is shorter than 1e-3 * max(|w|, 1)."""
    values = values or [f"f{j}" for j in range(N_FEATURES)]
    js = range(len(values))
    w = ", ".join(f"w{j}" for j in js)
    p = ", ".join(f"p{j}" for j in js)
    columns = ", ".join(f"CAST({v} AS DOUBLE) AS f{j}" for j, v in enumerate(values))
    margin = " + ".join(f"w{j} * f{j}" for j in js)
    step = ", ".join(
        f"any_value(w{j}) * (1 - 0.01 / sqrt(i + 1)) + sum(CASE WHEN y * m < 1 THEN y * f{j} ELSE 0 END) / count(*) / sqrt(i + 1)" for j in js
    )
    moved = " + ".join(f"(w{j} - p{j}) * (w{j} - p{j})" for j in js)
    norm = " + ".join(f"w{j} * w{j}" for j in js)
    return f"""
src AS MATERIALIZED (SELECT 2 * label - 1 AS y, {columns} FROM {source}),
it(i, {w}, {p}) AS (
  SELECT 0, {", ".join("0.0::DOUBLE" for _ in range(2 * len(values)))}
  UNION ALL
  SELECT i + 1, {step}, {", ".join(f"any_value(w{j})" for j in js)}
  FROM (SELECT *, {margin} AS m FROM it, src WHERE i < {iterations} AND NOT (i >= 2 AND sqrt({moved}) < 0.001 * greatest(sqrt({norm}), 1))) GROUP BY i),
fin AS (SELECT * FROM it ORDER BY i DESC LIMIT 1)"""


put(
    "svm_ranking",
    f"RECURSIVE {BITS.lstrip()}, {svm_recursion('bits', 100, [f'features[{j + 1}]' for j in range(N_BITS)])}",
    " UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS feature, {r6(f'w{j}')} AS score FROM fin" for j in range(N_BITS)),
)
put(
    "baseline_svm",
    f"RECURSIVE {LAB.lstrip()}, {svm_recursion('lab', 200)}",
    " UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS feature, {r6(f'w{j}')} AS weight FROM fin" for j in range(N_FEATURES)),
)

# ---- Naive Bayes --------------------------------------------------------------------------------------------------


def nb(source: str, name: str, keys: str = "", label: str = "label", features: int = N_FEATURES) -> str:
    """Prior and feature logs per (keys, label) from a long table with one row per id, keys and feature."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
{name}_s AS (SELECT {k}{label} AS label, feature, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s FROM {source} WHERE {label} IS NOT NULL GROUP BY ALL),
{name}_n AS (SELECT DISTINCT {k}label, n FROM {name}_s),
{name}_q AS (SELECT {k}label, ln(n + 1) - ln(sum(n) OVER ({part}) + count(*) OVER ({part})) AS log_prior FROM {name}_n),
{name} AS (
  SELECT {k}label, feature, log_prior, ln(s + 1) - ln(sum(s) OVER (PARTITION BY {k}label) + {features}) AS log_theta
  FROM {name}_s JOIN {name}_q USING ({k}label))"""


def linear_nb(name: str, keys: str = "") -> str:
    """The two-class model as weights and a bias: (keys, feature, w, b)."""
    k = f"{keys}, " if keys else ""
    return f"""
{name}_l AS (
  SELECT {k}feature, sum(CASE WHEN label = 1 THEN log_theta ELSE -log_theta END) AS w,
    sum(CASE WHEN label = 1 THEN log_prior ELSE -log_prior END) AS b FROM {name} GROUP BY ALL)"""


put(
    "nb_params",
    f"{LAB}, {long_form('lab')}, {nb('long', 'nb')}",
    f"SELECT label, CAST(feature AS BIGINT) AS feature, {r6('log_prior')} AS log_prior, {r6('log_theta')} AS log_theta FROM nb",
)

# Rows with the margin of one model fitted on all rows.
SCORED = f"""{long_form('lab')}, {nb('long', 'nb')}, {linear_nb('nb')},
margin AS (SELECT id, sum(value * w) + any_value(b) AS m FROM long JOIN nb_l USING (feature) GROUP BY id),
scored AS (
  SELECT lab.*, m, {r6(sigmoid('m'))} AS score, CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM lab JOIN margin USING (id))"""

put("nb_predict", f"{LAB}, {SCORED}", "SELECT id, score AS p1, prediction FROM scored")

put(
    "committee_debug_dump",
    f"{LAB}, {SCORED}",
    """SELECT list, CASE WHEN list = 'expert' AND score = 0.5 THEN 1.0::DOUBLE ELSE prediction END AS prediction, label, CAST(count(*) AS BIGINT) AS n
FROM scored CROSS JOIN (VALUES ('expert'), ('member')) t(list) GROUP BY ALL""",
)

# ---- label-regularized objective ----------------------------------------------------------------------------------


def objective_sums() -> str:
    """Sums of one pass at the given weights on scaled features."""
    return f"""{LAB}, {long_form('lab')}, {given()},
std AS (SELECT feature, stddev_samp(value) AS s FROM long GROUP BY feature),
z AS (SELECT id, label, feature, CASE WHEN s > 0 THEN value / s ELSE 0 END AS z FROM long JOIN std USING (feature)),
mar AS (SELECT id, any_value(label) AS label, sum(z * w) AS m FROM z JOIN w USING (feature) GROUP BY id),
sig AS (SELECT id, label, {sigmoid('m')} AS s, {softplus_neg('m')} AS l FROM mar),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS np, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n0,
  sum(l) FILTER (label = 1) AS lp, sum(s) FILTER (label = 0) / count(*) FILTER (label = 0) AS ph FROM sig),
gr AS (SELECT feature, sum(CASE WHEN label = 1 THEN (s - 1) * z ELSE 0 END) AS gp, sum(CASE WHEN label = 0 THEN s * (1 - s) * z ELSE 0 END) AS gu
  FROM z JOIN sig USING (id, label) GROUP BY feature),
nrm AS (SELECT sum(w * w) AS ww FROM w)"""


def objective(value: str, slope: str) -> str:
    return f"""SELECT 'loss' AS item, CAST(-1 AS BIGINT) AS feature, {r6(f'lp / n + 0.0005 * ww + 2 * ({value})')} AS value FROM tot, nrm
UNION ALL SELECT 'p_hat', -1, {r6('ph')} FROM tot
UNION ALL SELECT 'gradient', CAST(feature AS BIGINT), {r6(f'gp / n + 0.001 * w + 2 * ({slope}) * gu / n0')} FROM gr JOIN w USING (feature), tot"""


def kl(p: str) -> tuple[str, str]:
    return f"-{p} * ln(ph) + (1 - {p}) * ln((1 - {p}) / (1 - ph))", f"(1 - {p}) / (1 - ph) - {p} / ph"


put("lrlr_objective", objective_sums(), objective(*kl("0.05::DOUBLE")))
_b = "(sqrt(0.05 * ph) + sqrt(0.95 * (1 - ph)))"
put("lrlr_objective_bh", objective_sums(), objective(f"-ln({_b})", f"-(sqrt(0.05 / ph) - sqrt(0.95 / (1 - ph))) / (2 * {_b})"))
_value, _slope = kl("0.01::DOUBLE")
put(
    "lrlr_sgd_step",
    f"""{objective_sums()},
nxt AS (SELECT feature, w - (gp / np + 0.01 * w + 10 * ({_slope}) * gu / n0) AS w FROM gr JOIN w USING (feature), tot)""",
    f"""SELECT 'penalty' AS item, CAST(-1 AS BIGINT) AS feature, {r6(f'0.005 * (SELECT sum(w * w) FROM nxt) + 10 * ({_value})')} AS value FROM tot
UNION ALL SELECT 'weight', CAST(feature AS BIGINT), {r6('w')} FROM nxt""",
)
put(
    "mean_unlabeled_score",
    f"{LAB}, m AS (SELECT {hash32('id', 11)} % 3 AS fold, label, {dot()} AS m FROM lab)",
    f"SELECT fold, {r6('avg(' + sigmoid('m') + ')')} AS p_hat FROM m WHERE label = 0 GROUP BY fold",
)
_m = f"m AS (SELECT id, {dot(bias='-0.3::DOUBLE')} AS m FROM lab)"
put("lr_predict", f"{LAB}, {_m}", f"SELECT id, CASE WHEN {sigmoid('m')} > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM m")
put("lr_score", f"{LAB}, {_m}", f"SELECT id, {r6(sigmoid('m'))} AS score FROM m")


def pu_recursion(iterations: int, step: float, p: str, lam: float, reg: float, buckets: int = 0, fraction: float = 1.0) -> str:
    """Label-regularized gradient steps on scaled features, from zero weights: on all rows until the short-step rule stops
    them, or each on the hash buckets it draws."""
    js = range(N_FEATURES)
    m = "(" + " + ".join(f"w{j} * z{j}" for j in js) + ")"
    s = sigmoid(m)
    ph = f"(sum(CASE WHEN label = 0 THEN {s} ELSE 0 END) / count(*) FILTER (label = 0))"
    slope = f"((1 - {p}) / (1 - {ph}) - {p} / {ph})"
    steps = ", ".join(
        f"""any_value(w{j}) - {step} / sqrt(i + 1) * (sum(CASE WHEN label = 1 THEN ({s} - 1) * z{j} ELSE 0 END) / count(*) FILTER (label = 1)
      + {reg} * any_value(w{j}) + {lam} * {slope} * sum(CASE WHEN label = 0 THEN {s} * (1 - {s}) * z{j} ELSE 0 END) / count(*) FILTER (label = 0))"""
        for j in js
    )
    w = ", ".join(f"w{j}" for j in js)
    before = ", ".join(f"p{j}" for j in js)
    moved = " + ".join(f"(w{j} - p{j}) * (w{j} - p{j})" for j in js)
    norm = " + ".join(f"w{j} * w{j}" for j in js)
    stds = ", ".join(f"stddev_samp(f{j}) AS s{j}" for j in js)
    zs = ", ".join(f"CASE WHEN s{j} > 0 THEN f{j} / s{j} ELSE 0 END AS z{j}" for j in js)
    bucket = f"{hash32('id', 42)} % {buckets}" if buckets else "0"
    draw = "CAST('0x' || substr(md5(CAST(b AS VARCHAR) || ':' || CAST(42 + i AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    rows = "src" if not buckets else "(SELECT i AS nth, src.* FROM drawn JOIN src USING (bucket)) src"
    stop = "" if buckets else f" AND NOT (i >= 2 AND sqrt({moved}) < 0.001 * greatest(sqrt({norm}), 1))"
    draws = f"drawn AS MATERIALIZED (SELECT i, b AS bucket FROM range(1, {iterations + 1}) s(i), range({buckets}) t(b) WHERE {draw} < {fraction}),"
    return f"""
stds AS (SELECT {stds} FROM lab),
src AS MATERIALIZED (SELECT label, {bucket} AS bucket, {zs} FROM lab, stds),
{draws if buckets else ""}
it(i, {w}, {before}) AS (
  SELECT 0, {", ".join("0.0::DOUBLE" for _ in range(2 * N_FEATURES))}
  UNION ALL
  SELECT i + 1, {steps}, {", ".join(f"any_value(w{j})" for j in js)}
  FROM it, {rows} WHERE i < {iterations}{" AND nth = i + 1" if buckets else stop} GROUP BY i),
fin AS (SELECT * FROM it ORDER BY i DESC LIMIT 1)"""


def newton_recursion(iterations: int = 30) -> str:
    """Full Newton steps for three features, the 3 x 3 system by determinants, for each left-out fold and penalty."""
    js = range(3)
    m = " + ".join(f"w{j} * f{j}" for j in js)
    g = ", ".join(f"avg((s - label) * f{j}) + any_value(reg * w{j}) AS g{j}" for j in js)
    h = ", ".join(f"avg(s * (1 - s) * f{j} * f{k}){' + any_value(reg)' if j == k else ''} AS h{j}{k}" for j in js for k in js if j <= k)

    def det(columns: list[list[str]]) -> str:
        a, b, c = columns
        return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"

    own = [[f"h{min(j, k)}{max(j, k)}" for k in js] for j in js]
    right = [f"g{k}" for k in js]
    steps = ", ".join(f"w{j} - {det([right if k == j else own[k] for k in js])} / {det(own)}" for j in js)
    return f"""
src AS MATERIALIZED (SELECT {hash32('id', 11)} % 3 AS fold, label, CAST(f0 AS DOUBLE) AS f0, CAST(f1 AS DOUBLE) AS f1, CAST(f2 AS DOUBLE) AS f2 FROM lab),
it(left_out, reg, i, w0, w1, w2) AS (
  SELECT o - 1, r, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM range(4) t(o), (VALUES (0.0::DOUBLE), (0.01::DOUBLE)) u(r)
  UNION ALL
  SELECT left_out, reg, i + 1, {steps} FROM (
    SELECT left_out, reg, i, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, {g}, {h}
    FROM (SELECT *, {sigmoid('(' + m + ')')} AS s FROM it JOIN src ON src.fold <> it.left_out WHERE i < {iterations}) GROUP BY left_out, reg, i)),
fin AS (SELECT * FROM it WHERE i = {iterations})"""


put(
    "lr_newton",
    f"RECURSIVE {LAB.lstrip()}, {newton_recursion()}",
    " UNION ALL ".join(f"SELECT CAST(left_out AS BIGINT) AS left_out, reg, CAST({j} AS BIGINT) AS feature, {r6(f'w{j}')} AS weight FROM fin" for j in range(3)),
)
put(
    "lrlr_minibatch",
    f"RECURSIVE {LAB.lstrip()}, {pu_recursion(100, 0.5, '0.05::DOUBLE', 1.0, 0.01, 100, 0.1)}",
    " UNION ALL ".join(
        [f"SELECT CAST({j} AS BIGINT) AS feature, {r6(f'CASE WHEN s{j} > 0 THEN w{j} / s{j} ELSE 0 END')} AS weight FROM fin, stds" for j in range(N_FEATURES)]
        + ["SELECT CAST(-1 AS BIGINT), CAST(count(*) AS DOUBLE) FROM drawn JOIN src USING (bucket)"]
    ),
)
put(
    "lrlr_sgd_fit",
    f"RECURSIVE {LAB.lstrip()}, {pu_recursion(100, 0.5, '0.05::DOUBLE', 1.0, 0.01)}",
    " UNION ALL ".join(
        f"SELECT CAST({j} AS BIGINT) AS feature, {r6(f'CASE WHEN s{j} > 0 THEN w{j} / s{j} ELSE 0 END')} AS weight FROM fin, stds"
        for j in range(N_FEATURES)
    ),
)


def argmax(a: str, b: str) -> str:
    return f"CASE WHEN {b} > greatest({a}, 0) THEN 2.0::DOUBLE WHEN {a} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


put(
    "multinomial_predict",
    f"{LAB}, m AS (SELECT id, {dot()} AS a, {dot(weight=lambda j: f'sin({j} + 11) / 10')} AS b FROM lab)",
    f"SELECT id, {argmax('a', 'b')} AS plain, {argmax('(a + 0.1)', '(b + 0.2)')} AS biased FROM m",
)

_TECHNIQUES = ", ".join(f"'{t}'" for t in TECHNIQUES)
put(
    "hetero_draws",
    f"{BIT_CLASSES}, {bags()}",
    f"SELECT bag_id, [{_TECHNIQUES}][{hash32('bag_id', 7)} % {len(TECHNIQUES)} + 1] AS technique FROM bag_ids",
)

# ---- committees ---------------------------------------------------------------------------------------------------

# Margins of every row under every bag's model.
COMMITTEE = f"""{LAB}, {bags()}, {long_form('bagged', 'blong', 'bag_id, label')}, {long_form('lab')},
{nb('blong', 'nb', 'bag_id')}, {linear_nb('nb', 'bag_id')},
margin AS (SELECT id, bag_id, any_value(label) AS label, sum(value * w) + any_value(b) AS m FROM long JOIN nb_l USING (feature) GROUP BY id, bag_id)"""


def pooled(source: str = "margin") -> str:
    return f"""
pool AS (SELECT id, any_value(label) AS label, count(*) FILTER (m > 0) AS votes, count(*) AS k, sum({sigmoid('m')}) AS certainty FROM {source} GROUP BY id),
judged AS (SELECT id, label, votes, certainty, CASE WHEN votes * 2 > k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS vote,
  CASE WHEN k - certainty > certainty THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS expert FROM pool)"""


put("committee_vote", f"{COMMITTEE}, {pooled()}", "SELECT id, CAST(votes AS BIGINT) AS votes, vote AS prediction FROM judged")
put("committee_expert", f"{COMMITTEE}, {pooled()}", f"SELECT id, {r6('certainty')} AS certainty, expert AS prediction FROM judged")


def area(start: str = "spark") -> str:
    """auPRC of (tp, n_pred, pos, n)."""
    base, p, r = "(pos / n)", "(tp / n_pred)", "(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END)"
    if start == "legacy":
        return f"CASE WHEN n_pred = 0 THEN (1 + {base}) / 2 ELSE {r} * (1 + {p}) / 2 + (1 - {r}) * ({p} + {base}) / 2 END"
    return f"CASE WHEN n_pred = 0 THEN {base} ELSE {r} * {p} + (1 - {r}) * ({p} + {base}) / 2 END"


def counts(source: str, name: str, keys: str = "", prediction: str = "prediction", label: str = "label") -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
{name} AS (SELECT {k}CAST(count(*) FILTER ({prediction} = 1 AND {label} = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER ({prediction} = 1) AS DOUBLE) AS n_pred,
  CAST(count(*) FILTER ({prediction} = 1 AND {label} = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER ({label} = 1) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n
  FROM {source} {group})"""


put(
    "committee_avg_auprc",
    f"""{COMMITTEE}, {pooled()}, mp AS (SELECT bag_id, label, CASE WHEN m > 0 THEN 1 ELSE 0 END AS prediction FROM margin),
{counts('mp', 'c1', 'bag_id')}, {counts('judged', 'c2', prediction='vote')}, {counts('judged', 'c3', prediction='expert')}""",
    f"""SELECT 'average' AS rule, {r6(f'avg({area()})')} AS auprc FROM c1
UNION ALL SELECT 'vote', {r6(area())} FROM c2 UNION ALL SELECT 'expert', {r6(area())} FROM c3""",
)
put(
    "committee_per_bag_features",
    f"""{LAB}, {bags()}, {long_form('bagged', 'ball', 'bag_id, label')},
blong AS (SELECT * FROM ball WHERE feature IN (bag_id % 10, (bag_id + 3) % 10, (bag_id + 6) % 10)), {long_form('lab')},
{nb('blong', 'nb', 'bag_id', features=3)}, {linear_nb('nb', 'bag_id')},
margin AS (SELECT id, bag_id, any_value(label) AS label, sum(value * w) + any_value(b) AS m FROM long JOIN nb_l USING (feature) GROUP BY id, bag_id),
{pooled()}""",
    f"SELECT id, CAST(votes AS BIGINT) AS votes, {r6('certainty')} AS certainty, vote, expert FROM judged",
)
put(
    "committee_vote_linear",
    f"""{LAB}, {long_form('lab')},
margin AS (SELECT id, b AS bag_id, any_value(label) AS label, sum(value * sin((feature + 1) * (b + 1))) - 0.5 AS m FROM long, range(4) t(b) GROUP BY id, b),
{pooled()}""",
    "SELECT id, CAST(votes AS BIGINT) AS votes, vote AS prediction FROM judged",
)

put(
    "committee_own_top_features",
    f"""{_bag_rel},
ranked AS (SELECT bag_id, feature, row_number() OVER (PARTITION BY bag_id ORDER BY round(abs(mi), 12) DESC, feature) AS rank FROM rel),
mine AS (SELECT bag_id, feature FROM ranked WHERE rank <= 5),
blong AS (SELECT long.* FROM long JOIN mine USING (bag_id, feature)), {nb('blong', 'nb', 'bag_id', features=5)}, {linear_nb('nb', 'bag_id')},
{bits_long('lab', 'each')},
margin AS (SELECT id, bag_id, any_value(label) AS label, sum(value * w) + any_value(b) AS m FROM each JOIN nb_l USING (feature) GROUP BY id, bag_id),
{pooled()}""",
    f"SELECT id, CAST(votes AS BIGINT) AS votes, {r6('certainty')} AS certainty, vote, expert FROM judged",
)

# ---- metrics ------------------------------------------------------------------------------------------------------

NAN = "'NaN'::DOUBLE"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN {a} / {b} ELSE {NAN} END)"


_precision, _rate, _recall = div("tp", "(tp + fp)"), div("tp", "n"), div("tp", "pos")
FOLDED = f"{LAB}, {SCORED}, sf AS (SELECT *, {hash32('id', 11)} % 3 AS fold FROM scored)"
put(
    "metrics_basic",
    f"{FOLDED}, {counts('sf', 'c', 'fold')}, q AS (SELECT fold, n, {_rate} AS tp_rate_all, {_recall} AS recall, {_precision} AS precision FROM c)",
    f"""SELECT fold, CAST(n AS BIGINT) AS n, {r6('tp_rate_all')} AS tp_rate_all, {r6('recall')} AS recall, {r6('precision')} AS precision,
  {r6(div('2 * precision * tp_rate_all', '(precision + tp_rate_all)'))} AS f1_ref, {r6(div('2 * precision * recall', '(precision + recall)'))} AS f1 FROM q""",
)
put(
    "confusion_matrix",
    f"{LAB}, {SCORED}",
    """SELECT CAST(i AS BIGINT) AS actual, CAST(j AS BIGINT) AS predicted, CAST(count(id) AS BIGINT) AS n
FROM range(2) a(i) CROSS JOIN range(2) b(j) LEFT JOIN scored ON label = i AND prediction = j GROUP BY i, j""",
)
put(
    "temporal_rate",
    f"""{APPSEC}, lab AS (SELECT id, {CLASS_LABEL} AS label, {F_LIST} FROM appsec WHERE class IN ('playdrone_benign', 'high_mal')),
{long_form('lab')}, {nb('long', 'nb')}, {linear_nb('nb')},
later AS (SELECT id, {F_LIST} FROM appsec WHERE class = 'playdrone_benign' AND "scannersCount" > 9), {long_form('later', 'tlong', "1 AS x")},
margin AS (SELECT id, sum(value * w) + any_value(b) AS m FROM tlong JOIN nb_l USING (feature) GROUP BY id)""",
    f"SELECT {r6('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS rate FROM margin",
)
put(
    "pos_total_recall",
    f"""{LAB}, {noise(0.02, 0.5)}, {long_form('injected')}, {nb('long', 'nb')}, {linear_nb('nb')},
margin AS (SELECT id, sum(value * w) + any_value(b) AS m FROM long JOIN nb_l USING (feature) GROUP BY id)""",
    f"SELECT {r6('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS rate FROM margin JOIN injected USING (id) WHERE label = 1 OR real_label = 1",
)
put(
    "changed_metrics",
    f"""{BOTH}, {SCORED}, moved AS (SELECT * FROM scored WHERE label <> real_label), {counts('moved', 'c', label='real_label')},
q AS (SELECT n, {_rate} AS tp_rate_all, {_precision} AS precision FROM c)""",
    f"""SELECT CAST(n AS BIGINT) AS n, {r6('tp_rate_all')} AS tp_rate_all, {r6('precision')} AS precision,
  {r6(div('2 * precision * tp_rate_all', '(precision + tp_rate_all)'))} AS f1_ref FROM q""",
)
put(
    "auprc_hard",
    f"{FOLDED}, {counts('sf', 'c', 'fold')}",
    f"""SELECT 'spark' AS curve_start, fold, {r6(area())} AS auprc FROM c
UNION ALL SELECT 'legacy', fold, {r6(area('legacy'))} FROM c""",
)
put("auroc_hard", f"{FOLDED}, {counts('sf', 'c', 'fold')}", f"SELECT fold, {r6('(1 + tp / pos - fp / (n - pos)) / 2')} AS auroc FROM c")


def curve(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
pts AS (SELECT {k}score, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS q FROM {source} GROUP BY ALL),
cum AS (SELECT {k}score, p, q, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(q) OVER ({part} ORDER BY score DESC) AS fp,
  sum(p) OVER ({part}) AS pos, sum(q) OVER ({part}) AS neg FROM pts),
pr AS (SELECT {k}score, tp / pos AS r, tp / (tp + fp) AS pc, fp / neg AS fr FROM cum),
seg AS (SELECT {k}r, pc, fr, lag(r, 1, 0) OVER (w) AS r0, lag(pc) OVER (w) AS p0, lag(fr, 1, 0) OVER (w) AS f0, row_number() OVER (w) AS i FROM pr
  WINDOW w AS ({part} ORDER BY score DESC))"""


put(
    "auprc_score",
    f"{FOLDED}, {curve('sf', 'fold')}",
    f"""SELECT 'spark' AS curve_start, fold, {r6('sum((r - r0) * (pc + coalesce(p0, pc)) / 2)')} AS auprc, {r6('sum((fr - f0) * (r + r0) / 2)')} AS auroc FROM seg GROUP BY fold
UNION ALL SELECT 'legacy', fold, {r6('sum((r - r0) * (pc + coalesce(p0, 1)) / 2)')}, {r6('sum((fr - f0) * (r + r0) / 2)')} FROM seg GROUP BY fold""",
)
put(
    "pr_curve",
    f"{LAB}, {SCORED}, {curve('scored')}",
    f"SELECT {r6('score')} AS threshold, {r6('r')} AS recall, {r6('pc')} AS precision FROM pr",
)

def _scored_models() -> str:
    """Four models at given weights, their scores to nine digits."""
    parts = []
    for b in range(4):
        m = dot(bias=f"{-0.1 * b}::DOUBLE", weight=lambda j, b=b: f"sin(({j} + 1) * {b + 1}) / 10")
        parts.append(f"SELECT {b} AS model, id, label, {hash32('id', 11)} % 3 AS fold, {m} AS m FROM lab")
    return f"ms AS (SELECT model, fold, label, round({sigmoid('m')}, 9) AS score FROM ({' UNION ALL '.join(parts)}))"


put(
    "pr_curve_binned",
    f"""{LAB}, {_scored_models()},
sk AS (SELECT model, fold, least(floor(score * 16384), 16383) AS cell, count(*) FILTER (label > 0.5) AS pos, count(*) FILTER (NOT label > 0.5) AS neg FROM ms GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos + neg) OVER (PARTITION BY model, fold) AS n, sum(pos) OVER (PARTITION BY model, fold) AS np
  FROM sk WINDOW w AS (PARTITION BY model, fold ORDER BY cell DESC)),
bi AS (SELECT model, fold, (tp + fp - pos - neg) * 100 // n AS bin, min(cell) / 16384 AS threshold, max(tp) AS tp, max(fp) AS fp, max(np) AS np FROM cu GROUP BY ALL)""",
    f"""SELECT CAST(model AS BIGINT) AS model, CAST(fold AS BIGINT) AS fold, CAST(bin AS BIGINT) AS bin, {r6('threshold')} AS threshold,
  {r6('tp / np')} AS recall, {r6('tp / (tp + fp)')} AS precision FROM bi""",
)

# ---- cross-validation with Naive Bayes ----------------------------------------------------------------------------


def cross_validated(folds: int) -> str:
    """``cv`` (setting, id, fold, train, test, real_label, f*) -> ``pred`` with the prediction of the fold's model."""
    return f"""
{long_form('cv', 'clong', 'setting, fold, train, test')},
tr AS (SELECT setting, t.i AS out_fold, train AS label, feature, value FROM clong JOIN range({folds}) t(i) ON fold <> t.i WHERE train IS NOT NULL),
{nb('tr', 'nb', 'setting, out_fold')}, {linear_nb('nb', 'setting, out_fold')},
te AS (SELECT c.setting, c.id, c.fold, sum(value * w) + any_value(b) AS m FROM clong c
  JOIN nb_l ON c.setting = nb_l.setting AND c.fold = nb_l.out_fold AND c.feature = nb_l.feature WHERE test IS NOT NULL GROUP BY ALL),
pred AS (SELECT te.setting, te.fold, CASE WHEN m > 0 THEN 1 ELSE 0 END AS prediction, test AS label, real_label FROM te JOIN cv USING (setting, id))"""


_folds5 = f"{hash32('id', 11)} % 5"
put(
    "cv_summary",
    f"""{LAB}, {noise(0.02, 0.5)},
role AS (SELECT id, 'v1' AS setting, label AS train, truth FROM noisy
  UNION ALL SELECT id, 'v0', CASE WHEN label = 0 THEN 0.0::DOUBLE WHEN {unit('id', 11)} < 0.5 THEN 1.0::DOUBLE END, label FROM lab),
cv AS (SELECT setting, id, {_folds5} AS fold, train, train AS test, truth AS real_label, {F_LIST} FROM role JOIN (SELECT id, {F_LIST} FROM lab) USING (id)),
{cross_validated(5)}, {counts('pred', 'c', 'setting, fold', label='real_label')}""",
    f"""SELECT setting, 'truth_auprc' AS metric, {r6(f'avg({area()})')} AS value, CAST(count(*) AS BIGINT) AS n_folds FROM c GROUP BY setting""",
)
_folds3 = f"{hash32('id', 11)} % 3"
put(
    "cv_temporal",
    f"""{BOTH},
cv AS (SELECT s AS setting, id, {_folds3} AS fold, CASE WHEN s = 'label' OR label = real_label THEN label END AS train, label AS test, real_label, {F_LIST}
  FROM lab CROSS JOIN (VALUES ('kept'), ('label')) v(s)),
{cross_validated(3)}, {counts('pred', 'c', 'setting, fold')}, moved AS (SELECT * FROM pred WHERE label <> real_label),
{counts('moved', 'c2', 'setting, fold', label='real_label')}, q AS (SELECT setting, fold, {_rate} AS rate, {_precision} AS precision FROM c2)""",
    f"""SELECT setting, fold, 'label_auprc' AS metric, {r6(area())} AS value FROM c
UNION ALL SELECT setting, fold, 'changed_tp_rate_all', {r6('rate')} FROM q
UNION ALL SELECT setting, fold, 'changed_f1_ref', {r6(div('2 * precision * rate', '(precision + rate)'))} FROM q""",
)
put(
    "cv_highconf",
    f"""{APPSEC},
lab AS (SELECT id, {count_label(9, 10)} AS label, {TRUTH} AS real_label, {F_LIST} FROM appsec WHERE "scannersCount" <> -1),
cv AS (SELECT 'all' AS setting, id, {_folds3} AS fold, label AS train, CASE WHEN real_label <> -1 THEN label END AS test, real_label, {F_LIST} FROM lab),
{cross_validated(3)}, {counts('pred', 'c', 'setting, fold', label='real_label')}""",
    f"""SELECT setting, fold, 'truth_auprc' AS metric, {r6(area())} AS value FROM c
UNION ALL SELECT setting, fold, 'truth_precision', {r6(_precision)} FROM c""",
)
