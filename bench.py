"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "firing_rates", "isi_stats", "amplitude_stats", "summary_electrodes", "fano_factors", "rate_forecast", "bursts_max_interval", "network_bursts", "avalanches", "powerlaw_mle", "updown_epochs",
    "ccg_counts", "stdp_pairs", "stim_trials", "cofiring_phi", "mi_pairs", "lagged_corr", "transfer_entropy", "evolution_windows", "dynamic_fc", "artifact_flags", "sequence_motifs",
    "cosinor_24h", "triad_census", "welch_psd", "granger", "hmm_updown", "composite_score", "report",
]
#: Run once before the clock starts: one of each kind, built-in functions and Python workers.
WARM_UP = ["firing_rates", "isi_stats", "welch_psd"]


def main() -> None:
    from pulselake.plans import catalog
    from pulselake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores=cpus, shuffle_partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the session and touch the file
    for name in WARM_UP:  # code is compiled and workers are up; the measured runs still read and compute all
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    found: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "warm_up": WARM_UP, "queries": found, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
