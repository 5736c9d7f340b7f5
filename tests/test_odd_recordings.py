"""Every event query on recordings without events, with one event, and with channels of one event: defined results, no exception."""

import datetime
import math
from concurrent.futures import ThreadPoolExecutor

import pytest

from pulselake.plans import catalog

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
T = datetime.datetime(2024, 1, 1)
RECORDINGS = {
    "empty": [],
    "one": [(0, T, 3, "view", 1.5, "{}")],
    "lone": [(i, T + datetime.timedelta(minutes=7 * i), 3 if i else 9, ["view", "purchase"][i % 2], 1.0 + i % 5, "{}") for i in range(40)],
}


@pytest.mark.parametrize("kind", RECORDINGS)
def test_every_query(spark, tmp_path_factory, kind):
    path = str(tmp_path_factory.mktemp(kind))
    spark.createDataFrame(RECORDINGS[kind], SCHEMA).coalesce(1).write.parquet(f"{path}/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").coalesce(1).write.parquet(f"{path}/embeddings.parquet")

    def run(name):
        try:
            rows = catalog.QUERIES[name](spark, path).collect()
        except Exception as error:
            return f"{name}: {str(error)[:200]}"
        return f"{name}: not a number" if any(isinstance(v, float) and math.isnan(v) for r in rows for v in r) else None

    with ThreadPoolExecutor(8) as pool:
        failed = [x for x in pool.map(run, sorted(catalog.QUERIES)) if x]
    assert not failed, "\n".join(failed)
