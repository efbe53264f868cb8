"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from check_oracles import session
from rareboost.operators.boosting import Config, train
from rareboost.operators.sampling import Adaptive, Uniform
from rareboost.operators.scoring import transform
from rareboost.plans.catalog import QUERIES
from rareboost.plans.fixtures import FEATURES, lines

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

CATALOG = [
    "f1_cut_points", "f2_bin_rows", "f5_target_encode_oof", "f8_feature_set", "o3_focal", "a2_goss", "a3_adaptive", "a6_segment_quotas",
    "h1_histogram", "h6_best_split", "h12_grow_tree", "c1_stratified_folds", "c2_temporal_folds", "c9_isotonic_breakpoints",
    "c12_platt_fit", "m8_metric_record", "m16_rank_normalised",
]
DEEP = Config(n_rounds=3, learning_rate=0.1, sampler=Uniform(1.0), col_subsample=1.0, calibrate=False)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(os.environ.get("BENCH_CPUS"))
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times: dict[str, float] = {}

    def timed(name: str, work):
        start = time.time()
        out = work()
        times[name] = round(time.time() - start, 3)
        return out

    for name in CATALOG:
        timed(name, lambda: run(QUERIES[name](spark, SF_DIR)))
    # Three rounds of depth six on all rows; sampled and calibrated; then 30 trees of scoring.
    model = timed("train_depth6_3_rounds", lambda: train(lines(spark, SF_DIR), FEATURES, DEEP))
    sampled = replace(DEEP, sampler=Adaptive(0.2, 0.1, 0.5), calibrate=True, col_subsample=0.8)
    timed("train_adaptive_calibrated_3_rounds", lambda: train(lines(spark, SF_DIR), FEATURES, sampled))
    thirty = replace(model, trees=model.trees * 10)
    timed("score_30_trees", lambda: run(transform(lines(spark, SF_DIR), thirty, "raw").select("row_id", "p")))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
