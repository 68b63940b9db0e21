"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from faintlabel.learning.fits import Fit  # noqa: E402
from faintlabel.learning.training import evaluate  # noqa: E402
from faintlabel.plans.queries import QUERIES, given_weights  # noqa: E402
from faintlabel.session import held  # noqa: E402
from faintlabel.sources import tables as T  # noqa: E402
from faintlabel.operators import labeling as L  # noqa: E402

HEADLINE = (
    "label_2016 kfold_assign inject_noise balanced_bags family_one_shot class_counts contingency mi_relevance mi_redundancy "
    "mim_topk rank_mrmr merged_ranking nb_params nb_predict lrlr_objective lrlr_fit committee_vote committee_avg_auprc "
    "metrics_basic auprc_hard auprc_score pr_curve cv_summary cv_temporal x_noise x_lambdas x_temporal x_rank_committee"
).split()


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faintlabel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def objective_evaluations(spark: SparkSession, sf_dir: str, repeats: int = 5) -> tuple[dict[str, float], dict[str, int]]:
    """Seconds and Spark jobs per evaluation of the label-regularized objective on held rows."""
    wide = L.label_2016(T.appsec(spark, sf_dir)).select("label", *T.APPSEC_FEATURES)
    packed = T.vectors(spark, sf_dir).select("label", "features")
    seconds, jobs = {}, {}
    for name, df, fs in (("d10", wide, T.appsec_features()), ("d64", packed, T.vector_features())):
        fit = Fit("given", "pu", p_tilde=0.05)
        w = np.array(given_weights(fs.size))
        with held(df) as rows:
            evaluate(rows, fs, fit, w)
            group = f"objective-{name}"
            spark.sparkContext.setJobGroup(group, group)
            start = time.perf_counter()
            for _ in range(repeats):
                evaluate(rows, fs, fit, w)
            seconds[f"objective_eval_{name}"] = (time.perf_counter() - start) / repeats
            jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) // repeats
            spark.sparkContext.setJobGroup("bench", "bench")
    return seconds, jobs


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    QUERIES["label_by_class"](spark, sf_dir).count()  # start the workers
    times, jobs = objective_evaluations(spark, sf_dir)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - start
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "jobs_per_objective_evaluation": jobs,
            }
        )
    )


if __name__ == "__main__":
    main()
