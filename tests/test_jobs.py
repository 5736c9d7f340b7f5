"""The jobs against their SQL, over growing input, on reruns and odd rows, and by their command lines."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from test_catalog import _flat

from jobs import queries, recording_digest, stimulus_trains
from jobs.common import settings

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def rows_of(df):
    names = sorted(df.columns)
    return sorted(str([_flat(r[c]) for c in names]) for r in df.collect())


def sql_rows(name, **views):
    con = duckdb.connect()
    for view, path in views.items():
        con.execute(f"create view {view} as select * from read_parquet('{path}')")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    return sorted(str([_flat(float(v) if type(v).__name__ == "Decimal" else v) for _, v in sorted(zip(names, r, strict=True))]) for r in cur.fetchall()), sorted(names)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want, names = sql_rows(name, events=f"{SF}/events.parquet", documents=f"{SF}/documents.parquet")
    assert names == sorted(df.columns)
    assert rows_of(df) == want and want


def test_trains_take_only_what_is_new(spark, tmp_path):
    texts, out, p = tmp_path / "texts", str(tmp_path / "out"), settings("stimulus_trains")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    parts = [docs.where(f"doc_id % 3 = {k}").toPandas() for k in range(3)]
    texts.mkdir()
    told = []
    for k, part in enumerate(parts):
        part.to_parquet(texts / f"part-{k}.parquet")
        told.append(stimulus_trains.run(spark, str(texts), out, f"{out}/checkpoint", p))
    assert [t["read"] for t in told] == [len(x) for x in parts]  # each run reads the new file alone
    before = {x: x.stat().st_mtime_ns for x in Path(out, "trains").rglob("*.parquet")}
    again = stimulus_trains.run(spark, str(texts), out, f"{out}/checkpoint", p)
    assert again == {"read": 0, "trains": docs.count(), "groups": told[-1]["groups"]}
    assert before == {x: x.stat().st_mtime_ns for x in Path(out, "trains").rglob("*.parquet")}
    want, _ = sql_rows("job2_stimulus_trains", documents=f"{SF}/documents.parquet")
    assert rows_of(stimulus_trains.read(spark, out)) == want
    total = stimulus_trains.read(spark, out, "summary").selectExpr("sum(texts) as t", "sum(pulses) as p").first()
    assert (total.t, total.p) == (docs.count(), stimulus_trains.read(spark, out).selectExpr("sum(pulses)").first()[0])


def test_trains_of_odd_texts(spark, tmp_path):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "123 ***", "en", "a"), (None, "abc", "en", "a"), (4, "Ab é", "en", "7"), (4, "Ab é", "en", "7"), (5, "word " * 100_000, "en", "a")]
    spark.createDataFrame(rows, stimulus_trains.INPUT).selectExpr("*", "1 as pulses", "2 as runs").coalesce(1).write.parquet(f"{tmp_path}/texts")
    told = stimulus_trains.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out", f"{tmp_path}/checkpoint", settings("stimulus_trains"))
    assert told["read"] == told["trains"] == len(rows)
    want, _ = sql_rows("job2_stimulus_trains", documents=f"{tmp_path}/texts/*.parquet")
    got = stimulus_trains.read(spark, f"{tmp_path}/out")
    assert rows_of(got) == want
    one = got.where("doc_id = 4").first()
    assert (one.pulses, one.duration_ms, one.isi_mean_ms, one.amp_mean, one.channels_used, one.source) == (2, 250, 150.0, 1.5, 2, "7")


def test_trains_without_files(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    told = stimulus_trains.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out", f"{tmp_path}/checkpoint", settings("stimulus_trains"))
    assert told == {"read": 0, "trains": 0, "groups": 0}


def test_digest_replaces_only_its_days(spark, tmp_path):
    p, out = settings("recording_digest"), str(tmp_path / "out")
    events = spark.read.parquet(f"{SF}/events.parquet")
    first = events.selectExpr("min(ts)").first()[0]
    events.where(events.ts < first + __import__("datetime").timedelta(days=10)).write.parquet(f"{tmp_path}/ten")
    recording_digest.run(spark, f"{tmp_path}/ten", out, p)
    ten = rows_of(recording_digest.read(spark, out))
    assert recording_digest.run(spark, f"{tmp_path}/ten", out, p)["channel_days"] == len(ten)
    assert rows_of(recording_digest.read(spark, out)) == ten
    recording_digest.run(spark, f"{SF}/events.parquet", out, p)  # the recording has grown
    assert rows_of(recording_digest.read(spark, out)) == rows_of(queries.QUERIES["job1_recording_digest"](spark, SF))
    setting = spark.conf.get("spark.sql.sources.partitionOverwriteMode", None)
    assert setting in (None, "STATIC", "static")


@pytest.mark.parametrize("rows", [[], [(0, 5, 3)], [(0, 5, 3), (1, 5, 3)], [(0, 5, 3), (1, 300_000_000_000, 4)]])
def test_digest_of_small_recordings(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, c, "view", 1.5) for i, t, c in rows], "event_id long, t long, user_id long, event_type string, value double")
    df.selectExpr("event_id", "timestamp_micros(t) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events")
    recording_digest.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", settings("recording_digest"))
    got = recording_digest.read(spark, f"{tmp_path}/out").collect()
    assert sum(r.n for r in got) == len(rows) and len(got) in (0, 1, 8)
    if rows:
        want, _ = sql_rows("job1_recording_digest", events=f"{tmp_path}/events/*.parquet")
        assert rows_of(recording_digest.read(spark, f"{tmp_path}/out")) == want


def test_command_line(tmp_path):
    shutil.copytree(f"{SF}/documents.parquet", tmp_path / "texts") if os.path.isdir(f"{SF}/documents.parquet") else (tmp_path / "texts").mkdir() or shutil.copy(f"{SF}/documents.parquet", tmp_path / "texts" / "a.parquet")
    config = tmp_path / "own.json"
    config.write_text(json.dumps(settings("stimulus_trains") | {"ms_per_letter": 10}))
    call = [sys.executable, "-m", "jobs.stimulus_trains", "--texts", f"{tmp_path}/texts", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/state", "--config", str(config), "--master", "local[2]"]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_PYTHON": sys.executable})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new rows" in done.stderr and list(Path(tmp_path, "out", "trains").glob("source=*"))
