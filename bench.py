"""Times the headline queries on whole tables and prints one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Results go to a sink that reads every
row and column. One small query warms the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path
from time import perf_counter

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stratafold.catalog import registered  # noqa: E402
from stratafold.session import local_session  # noqa: E402

HEADLINE = [
    "oof_target_mean_auc", "clean_impute", "nested_folds", "roc_auc_pooled", "fold_auc_summary",
    "ratio_features", "digit_total", "ngram_bigrams", "frequency_encode", "reference_target_rate",
    "ecdf_rank", "ecdf_rank_by_contract", "quantile_distance", "nested_te_train", "te_test",
    "smoothed_te", "feature_matrix", "fold_encoded_matrix", "gbt_cv_oof",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries = registered()
    names = sys.argv[1:] or HEADLINE
    queries["label_map"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
