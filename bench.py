"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fathomgrid.models import priors, samplers, simulate
from fathomgrid.plans import registry
from fathomgrid.session import local

HEADLINE = ["listwise_panel", "panel_features", "ar1_forecast", "oos_r2", "ls_returns", "sharpe", "clark_west", "diebold_mariano", "loss_decomposition", "asset_descriptives", "corr_matrix", "sample_covariance", "cross_sort_pooled", "sharpe_diff_hac", "rolling_vol_band", "rhat_split", "effective_size", "interval_coverage", "lookahead_check", "ridge_backtest", "gibbs_backtest"]


def seconds_a_sweep(sweeps: int = 12) -> dict[str, float]:
    """Of the Gaussian and the LASSO sampler on simulated data of 25 assets, 719 months and 144 predictors."""
    s = simulate.simulate(25, 144, 719, seed=1, dev_sd=0.05)
    out = {}
    for model, prior in (("gaussian", priors.rescaled_prior(s.r, s.f)), ("lasso", priors.lasso_prior(s.r, s.f))):
        samplers.run(model, s.r, s.f, prior, 2, 1)
        began = time.perf_counter()
        samplers.run(model, s.r, s.f, prior, sweeps, 1)
        out[model] = round((time.perf_counter() - began) / sweeps, 4)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "panel_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "seconds_a_sweep": seconds_a_sweep(), "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
