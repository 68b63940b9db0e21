"""Cross-validated comparisons of baselines and label-regularized fits.

A sweep is a list of cases over one table.  Every variant of the labels (noise level, threshold, filter) is a column,
so all fits of all cases and folds share each data pass, and all models are tested in one more.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import ExitStack
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlabel.functions.hashing import hash_unit
from faintlabel.functions.scalar import divide
from faintlabel.learning.bayes import cell_sums, combine_sums, label_sums, model_of
from faintlabel.learning.committee import Scorer, prediction_counts
from faintlabel.learning.fits import Fit
from faintlabel.learning.models import LinearModel
from faintlabel.learning.repeats import Cells, blocked
from faintlabel.learning.training import Fitted, check_cells, fit_counted
from faintlabel.operators import labeling as L
from faintlabel.operators.features import FeatureSet
from faintlabel.operators.metrics import auprc_of_counts, auroc_of_counts, hard_counts, harmonic, positive_rate
from faintlabel.operators.sampling import family_one_shot, kfold_assign, noise_role, positive_counts, split_index
from faintlabel.session import held
from faintlabel.sources.results import RESULT_SCHEMA, save_predictions

BASELINES = ("naive_bayes", "logistic", "svm")


@dataclass(frozen=True)
class Case:
    """One setting: the column to train on, the column to test on, the folds, and the models to fit."""

    name: str
    train: str
    test: str
    folds: tuple[int | None, ...]
    params: dict = field(default_factory=dict)
    baselines: tuple[str, ...] = BASELINES
    grid: tuple[dict, ...] = ()


def pu_grid(p_tildes: Sequence[float], lambda_us: Sequence[float], reg_params: Sequence[float] = (0.0,)) -> tuple[dict, ...]:
    return tuple(
        {"p_tilde": p, "lambda_u": u, "reg_param": r} for r in reg_params for p in p_tildes for u in lambda_us
    )


def _plan_fits(cases: Sequence[Case], fold_col: str | None, divergence: str) -> list[tuple[Case, int | None, str, dict, Fit]]:
    out = []
    for c in cases:
        for f in c.folds:
            where = {"label": c.train, "fold_col": fold_col if f is not None else None, "left_out": f}
            if "logistic" in c.baselines:
                out.append((c, f, "logistic", {}, Fit(f"{c.name}|{f}|logistic", "logistic", **where)))
            if "svm" in c.baselines:
                svm = Fit(f"{c.name}|{f}|svm", "hinge", reg_param=0.01, scale=False, **where)
                out.append((c, f, "svm", {}, svm))
            for i, g in enumerate(c.grid):
                pu = Fit(f"{c.name}|{f}|pu{i}", "pu", divergence=divergence, **where, **g)
                out.append((c, f, "label_regularized", g, pu))
    return out


def _bayes_models(
    df: DataFrame, features: FeatureSet, cases: Sequence[Case], fold_col: str | None, cells: Cells | None = None
) -> dict[tuple[str, int | None], LinearModel]:
    """Naive Bayes of every case and fold from one aggregate over the combinations of label variants.

    Label variants are nested by construction (hash cuts, count thresholds), so the combinations are few.  With ``cells``
    over a table of ``counted`` rows.
    """
    wanted = [c for c in cases if "naive_bayes" in c.baselines]
    if not wanted:
        return {}
    columns = sorted({c.train for c in wanted})
    keys = ([fold_col] if fold_col else []) + columns[:-1]
    if cells is not None:
        cube = cell_sums(df, features, cells)
    else:
        cube = label_sums(df, features, keys, columns[-1]).collect()  # folds x label combinations rows
    out = {}
    for c in wanted:
        for f in c.folds:
            rows = [r for r in cube if f is None or r[fold_col] != f]
            zero, one = (combine_sums([r for r in rows if r[c.train] == y], features.size) for y in (0.0, 1.0))
            out[c.name, f] = model_of(zero, one, features.size)
    return out


def count_metrics(counts: DataFrame) -> DataFrame:
    """(name, metric, value) for every metric of the sweeps, from prediction counts.

    Views: ``label`` (observed), ``truth`` (real label where present), ``changed`` (truth differs from the observed
    label), ``positive`` (positive by either label).
    """
    y, t = F.col("label"), F.col("real_label")
    truth = F.coalesce(t, y)
    changed = F.coalesce(t != y, F.lit(False))
    positive = (y == 1) | F.coalesce(t == 1, F.lit(False))

    def view(name, keep, value):
        return F.when(keep, F.struct(F.lit(name).alias("view"), value.alias("y")))

    views = F.array_compact(
        F.array(
            view("label", F.lit(True), y), view("truth", F.lit(True), truth), view("changed", changed, t),
            view("positive", positive, F.lit(1.0)),
        )
    )
    flat = counts.withColumn("v", F.explode(views)).select("name", "prediction", "n", "v.view", F.col("v.y").alias("y"))
    c = hard_counts(flat.withColumnRenamed("n", "w"), ["name", "view"], label="y", weight="w")
    tp, fp, n_pred, pos, n = (F.col(x) for x in ("tp", "fp", "n_pred", "pos", "n"))
    rate, precision = divide(tp, n), divide(tp, tp + fp)
    metrics = {
        "auprc": auprc_of_counts(tp, n_pred, pos, n),
        "auroc": auroc_of_counts(tp, n_pred, pos, n),
        "tp_rate_all": rate,
        "recall": divide(tp, pos),
        "precision": precision,
        "f1_ref": harmonic(precision, rate),
        "f1": harmonic(precision, divide(tp, pos)),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("m"), v.alias("value")) for k, v in metrics.items()])
    return c.select("name", "view", F.explode(pairs).alias("x")).select(
        "name", F.concat("view", F.lit("_"), "x.m").alias("metric"), "x.value"
    )


@dataclass
class Sweep:
    """Fold-level results, and the fits behind them."""

    results: DataFrame
    fitted: list[Fitted]

    def summary(self) -> DataFrame:
        """Mean over folds per setting, model and metric."""
        params = F.array_join(
            F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        )
        return (
            self.results.withColumn("setting", params)
            .groupBy("experiment", "setting", "model", "metric")
            .agg(F.avg("value").alias("value"), F.count("*").alias("n_folds"))
        )


def run_cases(
    df: DataFrame,
    features: FeatureSet,
    cases: Sequence[Case],
    experiment: str,
    metrics: Sequence[str],
    truth: str | None = None,
    fold_col: str | None = "fold",
    temporal: DataFrame | None = None,
    divergence: str = "kl",
    max_iter: int | None = None,
    svm_iterations: int = 200,
    tol: float | None = None,
    hold: str = "auto",
    prediction_dir: str | None = None,
    fit_metrics: bool = False,
) -> Sweep:
    """Fit and test all cases.  ``max_iter`` is for the logistic fits, ``svm_iterations`` for the SVM baselines.

    ``temporal`` is an extra all-positive set on which detection rates are taken; with ``prediction_dir`` the
    predictions of the first label-regularized model per prior on it are kept as CSV.  With ``fit_metrics`` every fit also
    reports how many passes it took (``evaluations``) and whether its own test ended it (``converged``).
    """
    planned = _plan_fits(cases, fold_col, divergence)
    columns = {c.train for c in cases} | {c.test for c in cases} | {x for x in (truth, fold_col) if x}
    with ExitStack() as stack:
        rows = stack.enter_context(held(df.select(*sorted(columns), *features.inputs), hold, experiment))
        fits = [p[4] for p in planned]
        table, cells, blocks = stack.enter_context(blocked(rows, features, sorted(columns), sorted({c.train for c in cases})))
        if fits:
            check_cells(rows, cells, fits)
        fitted = fit_counted(table, features, fits, cells, max_iter, tol, blocks=blocks, svm_iterations=svm_iterations) if fits else []
        bayes = _bayes_models(blocks, features, cases, fold_col, cells)
        entries: list[tuple[Case, int | None, str, dict, LinearModel]] = [
            (c, f, kind, g, m.model) for (c, f, kind, g, _), m in zip(planned, fitted)
        ]
        by_name = {c.name: c for c in cases}
        entries += [(by_name[name], f, "naive_bayes", {}, m) for (name, f), m in bayes.items()]
        scorers = [
            Scorer(str(i), m, c.test, fold_col if f is not None else None, f) for i, (c, f, _, _, m) in enumerate(entries)
        ]
        measured = count_metrics(prediction_counts(blocks, features, scorers, truth, cells)).filter(F.col("metric").isin(list(metrics)))
        got = [(int(r["name"]), r["metric"], r["value"]) for r in measured.collect()]  # models x metrics rows
        if temporal is not None:
            everywhere = [Scorer(s.name, s.model) for s in scorers]
            rates = positive_rate(prediction_counts(temporal, features, everywhere), ["name"], "n")
            got += [(int(r["name"]), "temporal_rate", r["rate"]) for r in rates.collect()]
    if temporal is not None and prediction_dir is not None:
        for _, _, kind, g, model in entries:
            if kind == "label_regularized":
                pairs = temporal.select(model.predict(temporal, features).alias("prediction"), F.lit(1.0).alias("label"))
                save_predictions(pairs, f"{prediction_dir}/temporal_{g['p_tilde']}.csv")
    if fit_metrics:
        got += [(i, m, float(getattr(f, m))) for i, f in enumerate(fitted) for m in ("evaluations", "converged")]
    run = uuid.uuid4().hex
    out = []
    for i, metric, value in sorted(got):
        c, f, kind, g, _ = entries[i]
        params = {k: str(v) for k, v in {**c.params, **g}.items()}
        out.append((run, experiment, params, -1 if f is None else f, kind, metric, value))
    return Sweep(df.sparkSession.createDataFrame(out, RESULT_SCHEMA), fitted)


# ---- the named sweeps -------------------------------------------------------------------------------------------

# The parameter lists of the published experiments.
NOISE_LEVELS = (0.0, 0.001, 0.005, 0.01, 0.02, 0.03, 0.05)
LABELED_SHARES = (0.005, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
LAMBDA_US = (0.5, 1, 5, 10, 20, 50, 100, 1000, 10000, 50000, 100000, 500000, 1000000)
REG_PARAMS = (0, 0.00001, 0.0001, 0.001, 0.05, 0.5, 1, 5, 10, 20, 100, 500, 1000, 10000)
TEMPORAL_PRIORS = (0.0, 0.001, 0.01, 0.0322, 0.05)
WEEKLY_PRIORS = (0.001, 0.01, 0.0322, 0.05)
WEEKLY_LAMBDAS = (1, 5, 10)
FAMILY_PRIORS = (0.05, 0.07, 0.1, 0.12)
SCANNER_LIMITS = (1, 2, 4, 6, 8, 10)
TEST_NOISE_LEVELS = (0.0, 0.001, 0.005, 0.01, 0.02, 0.032)
SEED = 11


def noise_sweep(
    df: DataFrame, features: FeatureSet, noise_levels: Sequence[float] = NOISE_LEVELS,
    labeled_shares: Sequence[float] = (0.5,), lambda_u: float = 1.0, reg_param: float = 0.0, k: int = 5,
    experiment: str = "injected_noise", key: str = "id", **options,
) -> Sweep:
    """Baselines and a fit with the prior set to the noise level, for each noise level and labeled share."""
    levels = [(s, n) for s in labeled_shares for n in noise_levels]
    cases = [
        Case(f"v{i}", f"v{i}", f"v{i}", tuple(range(k)), {"noise": n, "labeled": s}, grid=pu_grid([n], [lambda_u], [reg_param]))
        for i, (s, n) in enumerate(levels)
    ]
    with held(df.select(key, "label", *features.inputs), options.get("hold", "auto"), f"{experiment}-rows") as base:  # read twice
        counts = positive_counts(base)
        rows = kfold_assign(base.withColumns({"truth": F.col("label"), "_u": hash_unit(F.col(key), SEED)}), k, SEED, key)
        variants = {f"v{i}": noise_role(n, s, counts, SEED, key, F.col("_u")) for i, (s, n) in enumerate(levels)}
        return run_cases(rows.withColumns(variants), features, cases, experiment, ["truth_auprc"], truth="truth", **options)


def labeled_amount_sweep(df: DataFrame, features: FeatureSet, labeled_shares=LABELED_SHARES, **options) -> Sweep:
    """The noise sweep for several shares of positives that stay labeled."""
    return noise_sweep(df, features, labeled_shares=labeled_shares, experiment="labeled_amount", **options)


def lambda_sweep(
    df: DataFrame, features: FeatureSet, lambda_us=LAMBDA_US, reg_params=REG_PARAMS, p_tilde: float = 0.0, k: int = 5,
    key: str = "id", **options,
) -> Sweep:
    """Strength of the label regulariser against that of the L2 penalty.

    Every fit also reports its passes and whether it converged.
    """
    rows = kfold_assign(df, k, SEED, key)
    case = Case("all", "label", "label", tuple(range(k)), grid=pu_grid([p_tilde], lambda_us, reg_params))
    return run_cases(rows, features, [case], "lambdas", ["truth_auprc"], **{"fit_metrics": True, **options})


def temporal_sweep(
    df: DataFrame, features: FeatureSet, p_tildes=TEMPORAL_PRIORS, lambda_us=(1,), reg_param: float = 0.0, k: int = 5,
    changed_in_training: Sequence[bool] = (True,), experiment: str = "temporal", key: str = "id", **options,
) -> Sweep:
    """Train on the old labels, test on them and on the rows whose label changed later."""
    rows = kfold_assign(df, k, SEED, key).withColumn("kept", F.when(~L.is_changed(), F.col("label")))
    cases = [
        Case(
            f"changed={flag}", "label" if flag else "kept", "label", tuple(range(k)), {"changed_in_training": flag},
            grid=pu_grid(p_tildes, lambda_us, [reg_param]),
        )
        for flag in changed_in_training
    ]
    metrics = ["label_auprc", "changed_tp_rate_all", "changed_f1_ref"]
    return run_cases(rows, features, cases, experiment, metrics, truth="real_label", **options)


def changed_training_sweep(df: DataFrame, features: FeatureSet, **options) -> Sweep:
    """The temporal sweep without and with changed rows in training, three folds."""
    settings = {"p_tildes": WEEKLY_PRIORS, "lambda_us": WEEKLY_LAMBDAS, "k": 3, **options}
    return temporal_sweep(df, features, changed_in_training=(False, True), experiment="changed_training", **settings)


def family_sweep(
    positives: DataFrame, benign: DataFrame, features: FeatureSet, p_tildes=FAMILY_PRIORS, lambda_u: float = 1.0,
    reg_param: float = 0.0, benign_fraction: float = 0.01, key: str = "id", **options,
) -> Sweep:
    """One labeled row per family: baselines without the hidden rows, label-regularized fits with them."""
    split = family_one_shot(positives, benign, benign_fraction=benign_fraction, key=key)
    role = F.col("role")
    rows = split.withColumns(
        {
            "supervised": F.when(role == "labeled", 1.0).when(role == "benign", 0.0),
            "semi": F.when(role == "labeled", 1.0).when(role.isin("benign", "hidden"), 0.0),
            "test": F.when(role == "test", 1.0),
        }
    )
    cases = [
        Case("supervised", "supervised", "test", (None,), {"training": "supervised"}),
        Case("semi", "semi", "test", (None,), {"training": "semi"}, (), pu_grid(p_tildes, [lambda_u], [reg_param])),
    ]
    return run_cases(rows, features, cases, "family", ["label_auprc", "label_tp_rate_all"], fold_col=None, **options)


def highconf_sweep(
    df: DataFrame, features: FeatureSet, p_tilde: float = 0.0322, lambda_us: Sequence[float] = (1, 5, 10),
    with_count: bool = True, reg_param: float = 0.0, k: int = 3, baselines: tuple[str, ...] = (), key: str = "id", **options,
) -> Sweep:
    """Train on high confidence against the rest, test where the truth is known.

    ``with_count`` adds ten times the number of training positives of the first fold as a regulariser strength.
    """
    rows = kfold_assign(df, k, SEED, key).withColumn("test", F.when(F.col("real_label") != L.UNKNOWN, F.col("label")))
    strengths = list(lambda_us)
    if with_count:
        strengths.append(10 * rows.filter((F.col("fold") != 0) & (F.col("label") == 1)).count())
    case = Case("all", "label", "test", tuple(range(k)), {}, baselines, pu_grid([p_tilde], strengths, [reg_param]))
    return run_cases(rows, features, [case], "highconf", ["truth_auprc", "truth_precision"], truth="real_label", **options)


def noisy_benign_sweep(
    df: DataFrame, features: FeatureSet, limits: Sequence[int] = SCANNER_LIMITS, vary: str = "max_benign",
    p_tildes=(0.01, 0.05), lambda_us=(1, 5), reg_param: float = 0.0, k: int = 3, key: str = "id", **options,
) -> Sweep:
    """Detector counts up to which a row is benign, or (``min_malware``) from which it is malware.

    ``df`` holds unlabeled rows with ``scannersCount``; every limit is a label column of the same rows.
    """
    if vary not in ("max_benign", "min_malware"):
        raise ValueError("vary must be max_benign or min_malware")
    scanned = F.col("scannersCount") != L.NOT_SCANNED
    columns = {}
    for m in limits:
        rule = L.count_label(m, L.MIN_MALWARE) if vary == "max_benign" else L.count_label(0, m)
        columns[f"v{m}"] = F.when(scanned & (rule != L.UNKNOWN), rule)
    rows = kfold_assign(df, k, SEED, key).withColumns(columns)
    cases = [
        Case(f"v{m}", f"v{m}", f"v{m}", tuple(range(k)), {vary: m}, grid=pu_grid(p_tildes, lambda_us, [reg_param]))
        for m in limits
    ]
    return run_cases(rows, features, cases, f"noisy_benign_{vary}", ["label_auprc", "label_precision"], **options)


def unlabeled_sweep(
    df: DataFrame, features: FeatureSet, temporal: DataFrame | None = None, noise_levels: Sequence[float] = TEST_NOISE_LEVELS,
    lambda_u: float = 1.0, reg_param: float = 0.0, k: int = 3, key: str = "id", **options,
) -> Sweep:
    """Train on clean folds, test with noise put in the test part; detection rate on the later-positive set."""
    rows = kfold_assign(df.withColumn("truth", F.col("label")), k, SEED, key)
    per_fold = {
        r["fold"]: (r["p"], r["u"])
        for r in rows.groupBy("fold")
        .agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("u"))
        .collect()  # one row per fold
    }
    columns = {}
    for i, n in enumerate(noise_levels):
        role = F.lit(None).cast("double")
        for f, counts in per_fold.items():
            role = F.when(F.col("fold") == f, noise_role(n, 0.5, counts, SEED, key)).otherwise(role)
        columns[f"v{i}"] = role
    cases = [
        Case(f"v{i}", "label", f"v{i}", tuple(range(k)), {"noise": n}, grid=pu_grid([n], [lambda_u], [reg_param]))
        for i, n in enumerate(noise_levels)
    ]
    metrics = ["truth_auprc", "positive_tp_rate_all"]
    return run_cases(
        rows.withColumns(columns), features, cases, "unlabeled", metrics, truth="truth", temporal=temporal, **options
    )


def single_split(
    df: DataFrame, features: FeatureSet, p_tilde: float = 0.05, lambda_u: float = 1.0, reg_param: float = 0.0,
    key: str = "id", **options,
) -> Sweep:
    """One label-regularized fit on a .67/.33 split."""
    rows = df.withColumn("fold", split_index([0.67, 0.33], SEED, key))
    case = Case("split", "label", "label", (1,), {}, (), pu_grid([p_tilde], [lambda_u], [reg_param]))
    return run_cases(rows, features, [case], "single_split", ["label_auprc"], **options)
