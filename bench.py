"""Benchmark of the headline jobs; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is timed end to end from the parquet tables, including the pair
layout (distinct, counts, checkpoint) of its own fit.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from latentrec.operators.quantile import exact_quantile  # noqa: E402
from latentrec.operators.scoring import histogram, score_pairs  # noqa: E402
from latentrec.plans.model import fit, sweep  # noqa: E402
from latentrec.plans.recommend import predict  # noqa: E402
from latentrec.session import local_session  # noqa: E402
from latentrec.sources.interactions import (  # noqa: E402
    customer_brand_pairs,
    customer_part_pairs,
    events_pairs,
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    spark = local_session(os.path.join(scratch, "ckpt"), cores=cpus, shuffle_partitions=cpus)
    times: dict[str, float] = {}
    info: dict[str, object] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm-up: JVM start and first code generation are not part of any query
    events_pairs(spark, sf_dir).count()

    # The reference's configuration: 10 classes, 20 EM iterations.
    model = timed("fit_events_k10_i20", lambda: fit(events_pairs(spark, sf_dir), 10, 20))
    info["events_pairs"] = model.layout.n_pairs
    info["events_final_mean_ll"] = model.history_rows[-1][2]

    def scoring():
        t, preds = predict(model, quantile=0.9)
        return t, preds.where("recommended").count()

    threshold, n_rec = timed("score_grid_quantile_flag_events", scoring)
    info["events_threshold"] = threshold
    info["events_recommended"] = n_rec

    def hist():
        return histogram(score_pairs(model), "score", 30).collect()

    timed("score_histogram_events", hist)

    # the largest number of classes the reference compared
    timed("fit_events_k35_i5", lambda: fit(events_pairs(spark, sf_dir), 35, 5))

    cp = timed("fit_customer_part_k10_i5", lambda: fit(customer_part_pairs(spark, sf_dir), 10, 5))
    info["customer_part_pairs"] = cp.layout.n_pairs

    timed("fit_customer_brand_k10_i10", lambda: fit(customer_brand_pairs(spark, sf_dir), 10, 10))

    timed(
        "k_sweep_events_k3_4_5_i5",
        lambda: sweep(events_pairs(spark, sf_dir), [3, 4, 5], 5).collect(),
    )

    # the reference's own sweep: nine K
    timed(
        "k_sweep_events_nine_k_i20",
        lambda: sweep(events_pairs(spark, sf_dir), [3, 4, 5, 10, 15, 20, 25, 30, 35], 20).collect(),
    )

    def quantile_large():
        return exact_quantile(score_pairs(cp), "score", 0.9)

    info["customer_part_grid"] = cp.layout.n_users * cp.layout.n_items
    info["customer_part_q90"] = timed("exact_quantile_customer_part_grid", quantile_large)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_elapsed",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "info": info,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
