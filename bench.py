"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tallframe.plans.registry import ORACLES, QUERIES  # noqa: E402

HEADLINE = ["stim_moments", "align_linear", "overlap_add", "frame_mean", "notes_onehot_duration", "hist_match", "js_divergence", "autocorr_lags", "feature_covariance", "pca_project", "dft_magnitude", "weighted_moments", "nan_corr", "set_symdiff", "lowprob_merge"]
#: Timed beside them, once warm.
MORE = ["hilbert_envelope", "circular_autocorr", "resample_rational", "pchip_gap", "event_median", "windowed_autocorr", "filtered_correlation", "texture_sums", "fft_freqs", "channel_median"]
#: Queries whose SQL isn't timed, as it takes the square of a stimulus's length.
SLOW_SQL = {"dft_magnitude", "hilbert_envelope", "circular_autocorr"}


def duck_times(sf_dir: str, names: list[str], cpus: str) -> dict[str, float]:
    """The same queries' SQL in DuckDB on this machine, with as many threads: the median of three warm runs."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = {int(cpus)}; SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    took = {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLES[name]}")
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    return took


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    runs = []
    for _ in range(3):  # the first warms up
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - start)
    return round(statistics.median(runs[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp()).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    more = {name: timed(spark, name, sf_dir) for name in MORE}
    out = {"metric": "total of median warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "more": more}
    out["duckdb"] = duck_times(sf_dir, [n for n in [*HEADLINE, *MORE] if n in ORACLES and n not in SLOW_SQL], cpus)
    print(json.dumps(out | {"sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
