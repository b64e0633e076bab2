"""The ledger of an audit table: marks, claims, replays, listings that read the newest days only; windows that close."""

import datetime
import functools
import json
import re

import pytest
from pyspark.sql import functions as F

from scrubline.operators import audit, metrics
from scrubline.sources import audit_tables
from scrubline.sources.ledger import ConcurrentWriter, Ledger
from scrubline.streaming.jobs import start_audit_append, start_closed_windows

EVENT = "ts string, actor string, role string, action string, resource string, outcome string, metadata_json string"


def events(spark, day, count, tag="u"):
    rows = [(f"2024-01-{day:02d}T10:{k // 60:02d}:{k % 60:02d}+00:00", f"{tag}{k}", "operator", "inference", "v", "ok", '{"a": 1}') for k in range(count)]
    return spark.createDataFrame(rows, EVENT)


@pytest.fixture
def table(spark, tmp_path):
    """Ten days of twenty entries each, in order of time."""
    path = str(tmp_path / "audit")
    rows = functools.reduce(lambda a, b: a.unionByName(b), (events(spark, day, 20) for day in range(1, 11)))
    place = (F.col("ts").substr(9, 2).cast("long") - 1) * 20 + F.col("ts").substr(18, 2).cast("long") + 1
    audit_tables.create_audit(spark, audit.with_entry_hash(rows.coalesce(2)).withColumn("id", place), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield path
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def days_read(df):
    """The days that the partition filter of a plan's scan names."""
    return set(re.findall(r"2024-01-\d\d", plan_of(df).split("PartitionFilters: ")[1].split("PushedFilters")[0]))


def test_marks_are_those_of_the_rows(spark, table):
    rows = audit_tables.read_audit(spark, table)
    want = {str(r["dt"]): (r["n"], r["low"], r["high"]) for r in rows.groupBy("dt").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()}
    assert {r["day"]: tuple(r)[1:] for r in audit_tables.marks(spark, table).collect()} == want
    assert audit_tables.high_water(spark, table) == {"max_id": 200, "next_id": 201, "rows": 200}
    assert sorted(r["id"] for r in rows.select("id").collect()) == list(range(1, 201))


def test_an_append_reads_no_ids_and_no_old_days(spark, table, monkeypatch):
    read = []
    committed = audit_tables._committed

    def watched(spark, path, commit):
        rows = committed(spark, path, commit)
        where = rows.where

        def noted(condition):
            found = where(condition)
            read.append((days_read(found), found))
            return found

        rows.where = noted
        return rows

    monkeypatch.setattr(audit_tables, "_committed", watched)
    audit_tables.append_audit(spark, events(spark, 10, 30), table)
    assert [days for days, _ in read] == [{"2024-01-10"}]
    scan = plan_of(read[0][1].select("entry_hash"))
    assert "ReadSchema: struct<entry_hash:string>" in scan and "PartitionFilters: [" in scan
    assert audit_tables.high_water(spark, table)["max_id"] == 210


def test_listing_reads_the_last_days(spark, table, monkeypatch):
    audit_tables.append_audit(spark, events(spark, 3, 4, "late"), table)  # a late entry: day 3 holds the highest ids now
    everything = audit_tables.read_audit(spark, table)
    for n in (1, 3, 10, 50, 200):
        newest = audit_tables.newest_rows(spark, table, n)
        assert [r["id"] for r in newest.orderBy("id").collect()] == list(range(205 - n, 205))
        # day 3 has 24 rows, days 10, 9, 8 follow
        assert len(days_read(newest)) == {1: 1, 3: 1, 10: 2, 50: 4, 200: 10}[n]
    listed = audit_tables.list_latest_stored(spark, table, 50).collect()
    assert listed == audit.list_latest(everything, 50).select(*listed[0].__fields__).collect()
    assert audit_tables.audit_panel_stored(spark, table).collect() == audit.audit_panel(everything).collect()
    assert audit_tables.list_latest_stored(spark, table + "-none").count() == 0


def test_a_ledger_is_repaired_from_the_rows(spark, table):
    ledger = Ledger(spark, table)
    want = ledger.last()
    ledger.files.delete(ledger._hadoop(ledger.folder), True)
    assert audit_tables.read_audit(spark, table).count() == 0
    state = audit_tables.repair_ledger(spark, table)
    assert {k: state[k] for k in ("days", "rows", "max_id")} == {k: want[k] for k in ("days", "rows", "max_id")}
    audit_tables.append_audit(spark, events(spark, 11, 5), table)
    assert sorted(r["id"] for r in audit_tables.read_audit(spark, table).collect()) == list(range(1, 206))


def test_a_second_writer_is_refused(spark, table):
    ledger = Ledger(spark, table)
    ledger.claim(ledger.last()["commit"] + 1, "somebody else")
    with pytest.raises(ConcurrentWriter):
        audit_tables.append_audit(spark, events(spark, 11, 5), table)
    assert audit_tables.read_audit(spark, table).count() == 200
    audit_tables.append_new(spark, events(spark, 11, 5), table, take_over=True)
    assert audit_tables.read_audit(spark, table).count() == 205
    with pytest.raises(ConcurrentWriter):
        ledger.commit({"commit": ledger.last()["commit"]})


def test_a_batch_that_was_written_but_not_committed(spark, tmp_path, monkeypatch):
    source, path, state = str(tmp_path / "in"), str(tmp_path / "audit"), str(tmp_path / "state")
    for day in (1, 2, 3):
        events(spark, day, 10).coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(source)
        start_audit_append(stream, path, state).awaitTermination()

    commit = Ledger.commit

    def fail(self, state):
        if state["commit"] == 2:
            raise RuntimeError("lost before the commit")
        commit(self, state)

    monkeypatch.setattr(Ledger, "commit", fail)
    with pytest.raises(Exception, match="lost before the commit"):
        run()
    # the rows lie in the folder but are not part of the table
    assert spark.read.parquet(path).count() == 20 and audit_tables.read_audit(spark, path).count() == 10
    monkeypatch.setattr(Ledger, "commit", commit)
    run()
    rows = audit_tables.read_audit(spark, path).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 31)) and len({r["entry_hash"] for r in rows}) == 30
    assert spark.read.parquet(path).count() == 30


def test_a_committed_batch_is_skipped_without_reading(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    audit_tables.append_new(spark, events(spark, 1, 5), path, writer="stream", batch=4)
    monkeypatch.setattr(audit_tables, "_committed", None)
    assert audit_tables.append_new(spark, events(spark, 1, 5), path, writer="stream", batch=4) == 0
    assert Ledger(spark, path).last()["batches"] == {"stream": 4}


def test_rows_whose_time_cannot_be_read_have_a_mark(spark, tmp_path):
    path = str(tmp_path / "audit")
    odd = spark.createDataFrame([("no time", "u", "operator", "a", "v", "ok", "{}")], EVENT)
    for _ in range(2):
        audit_tables.append_audit(spark, events(spark, 1, 3).unionByName(odd), path)
    assert {r["day"]: r["rows"] for r in audit_tables.marks(spark, path).collect()} == {None: 1, "2024-01-01": 3}
    assert audit_tables.newest_rows(spark, path, 4).count() == 4


ACCESS = "ts timestamp, handler string, n int"


def test_windows_close_once_and_late_rows_are_kept(spark, tmp_path):
    def at(minute):
        return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)

    batches = [
        [(at(0), "a", 1), (at(5), "a", 2), (at(12), "b", 3)],
        [(at(9), "a", 4), (at(25), "a", 5)],  # 9 is late by the clock, but its window is open still
        [(at(8), "a", 6), (at(14), "b", 7), (at(26), "b", 8), (None, "a", 9)],  # 0-10 has closed at 25 - 10
        [(at(60), "a", 10)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, ACCESS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def run(state):
        stream = spark.readStream.schema(ACCESS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_closed_windows(stream, out, str(tmp_path / state), ["handler"], "10 minutes").awaitTermination()
        closed = {(r["window_start"].minute, r["handler"]): r["events"] for r in spark.read.parquet(out + "/closed").collect()}
        assert len(closed) == spark.read.parquet(out + "/closed").count()
        return closed, sorted(r["n"] for r in spark.read.parquet(out + "/late").collect())

    first = run("state-1")
    assert first == ({(0, "a"): 3, (10, "b"): 2, (20, "a"): 1, (20, "b"): 1}, [6, 9])
    assert run("state-2") == first  # all batches replayed
    last = spark.read.parquet(out + "/open/batch=3").where("window_start IS NOT NULL").collect()
    assert [(r["window_start"].hour, r["events"]) for r in last] == [(11, 1)]


def test_merged_sketches_are_as_good_as_one(spark):
    rows = spark.range(200_000).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("ok").alias("outcome"), ((F.col("id") * 7919) % 200_000 / 1000).alias("latency_s")
    )
    sketches = metrics.latency_sketches(rows.unionByName(rows.limit(5).withColumn("latency_s", F.lit(None).cast("double"))), ["outcome"])
    for q in (0.01, 0.5, 0.95, 0.999):
        found = metrics.sketch_quantile(sketches, ["outcome"], q).first()
        assert found["latency_count"] == 200_000 and found["windows"] == 139
        assert abs(found["sketch_quantile"] / 200 - q) <= 2 * metrics.sketch_error()
    assert sketches.agg(F.max(F.octet_length("latency_sketch"))).first()[0] < 20_000
    assert metrics.sketch_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_scenarios_of_several_lines_and_broken_ones(spark, tmp_path):
    from scrubline.sources.requests import broken_scenarios, read_scenarios

    good = {"title": "t", "scenarios": [{"id": "1", "label": "l", "context": "c\nd", "question": "q"}]}
    files = {
        "one": json.dumps(good, indent=2), "list": json.dumps([good, good], indent=1), "cut": json.dumps(good, indent=2)[:40],
        "other": '{"title": "x"}', "empty list": '{"title": "e", "scenarios": []}', "kind": '{"title": "k", "scenarios": 3}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert read_scenarios(spark, str(tmp_path)).count() == 3
    broken = {r["path"].split("/")[-1]: (r["reason"], r["text"]) for r in broken_scenarios(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in broken.items()} == {"cut.json": "no JSON", "other.json": "no scenarios", "kind.json": "no JSON"}
    assert broken["cut.json"][1].strip() == files["cut"].strip()


def test_a_merge_shuffles_little_of_the_table(spark, table):
    target = audit_tables.read_audit(spark, table)
    fresh = audit.with_entry_hash(events(spark, 9, 3, "other")).withColumn("id", F.lit(1000) + F.col("actor").substr(6, 1).cast("long"))
    source = target.where("id % 20 = 0").drop("dt").unionByName(fresh).select(*audit.AUDIT_COLUMNS)
    stored = audit_tables.written(source, "source")
    near = audit_tables.near_source(stored, target)
    passed = {r["entry_hash"] for r in near.collect()}
    shared = {r["entry_hash"] for r in target.where("id % 20 = 0").collect()}
    assert shared <= passed and len(passed) < 40
    plan = plan_of(audit.missing_entries(stored, near))
    assert "BroadcastHashJoin" in plan and "bitmap_construct_agg" in plan
    assert audit_tables.merge_audit(spark, source, table) == 3
    assert audit_tables.merge_audit(spark, source, table) == 0
    assert audit_tables.high_water(spark, table) == {"max_id": 1002, "next_id": 1003, "rows": 203}


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_the_filter_passes_all_that_are_in_it(spark, n):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("entry_hash"))
    hashes = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("entry_hash"))
    passed = audit.maybe_present(rows, hashes, n)
    assert passed.join(hashes, "entry_hash", "left_semi").count() == n
    assert passed.count() - n <= 20_000 / 8


def test_hashes_are_computed_once_a_row(spark):
    rows = audit.with_entry_hash(events(spark, 1, 3)).withColumn("id", F.lit(1))
    plan = plan_of(audit.missing_entries(rows, rows.select("entry_hash")))
    assert plan.count("ArrowEvalPython") <= 2
