"""Canonical JSON, hashes, and audit tables on storage."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scrubline.functions.canonical import canonical_json
from scrubline.operators import audit
from scrubline.session import scratch_path
from scrubline.sources import audit_tables

CANONICAL = [
    ('{"b": 1, "a": {"d": [3, 1], "c": null}}', '{"a":{"c":null,"d":[3,1]},"b":1}'),
    ('{"x": 12.0, "y": 0.50, "z": 12.34}', '{"x":12.0,"y":0.5,"z":12.34}'),
    ('{"x": 1e7, "y": 1e16, "z": 1e-5, "w": 1e-7}', '{"w":1e-7,"x":10000000.0,"y":1e16,"z":0.00001}'),
    ('{"x": -0, "n": 18446744073709551615, "m": 18446744073709551616}',
     '{"m":1.8446744073709552e19,"n":18446744073709551615,"x":-0.0}'),
    ('{"k": "é \\u00e9 / \\\\ \\" \\n"}', '{"k":"é é / \\\\ \\" \\n"}'),
    ('{"a": 1, "a": 2}', '{"a":2}'),
    ("[]", "[]"), ('"s"', '"s"'), ("null", "null"),
    ('{"a": ', None), ("NaN", None), ('{"a": 1} x', None), ('"\\ud800"', None), ("", None),
    ('{"a": 1} {"b": 2}', None), ('1] [2', None), ('1, 2', None), ('1} {', None), ("1e999", None), ("[" * 200 + "]" * 200, None),
]


def test_canonical_json(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CANONICAL)], "i int, j string")
    rows = df.select("i", canonical_json(F.col("j")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == [c[1] for c in CANONICAL]


def event(n, ts="2024-03-01T10:00:00.000000+00:00", metadata='{"b": 1.5, "a": 2}'):
    return (ts, f"user-{n}", "operator", "inference", "vault-answer", "ok", metadata)


EVENT = "ts string, actor string, role string, action string, resource string, outcome string, metadata_json string"


def test_hash_is_that_of_the_canonical_object(spark):
    row = audit.with_entry_hash(spark.createDataFrame([event(1)], EVENT)).first()
    fields = {k: row[k] for k in ("ts", "actor", "role", "action", "resource", "outcome")}
    fields["metadata"] = json.loads(row.metadata_json)
    text = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row.entry_hash == hashlib.sha256(text.encode()).hexdigest()


def test_ids_are_dense_with_one_hot_time(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit("t1")).otherwise(F.concat(F.lit("t2"), "id")).alias("ts"),
        F.sha2(F.col("id").cast("string"), 256).alias("entry_hash"),
    )
    numbered = audit.assign_ids(rows, ["ts", "entry_hash"], last_id=10, partitions=6).collect()
    ordered = sorted(numbered, key=lambda r: r.id)
    assert [r.id for r in ordered] == list(range(11, 3011))
    assert [(r.ts, r.entry_hash) for r in ordered] == sorted((r.ts, r.entry_hash) for r in ordered)


def test_append_verify_merge(spark):
    path, copy = scratch_path(spark, "t"), scratch_path(spark, "c")
    days = ["2024-03-01", "2024-03-02"]
    events = [event(n, f"{days[n % 2]}T10:00:00.{n:06d}+00:00") for n in range(20)]
    first, rest = spark.createDataFrame(events[:12], EVENT), spark.createDataFrame(events[12:], EVENT)
    audit_tables.append_audit(spark, first, path)
    audit_tables.append_audit(spark, rest, path)
    table = audit_tables.read_audit(spark, path)
    assert sorted(r.id for r in table.collect()) == list(range(1, 21))
    assert all(r.hash_valid for r in audit.verify(table).collect())
    audit_tables.append_new(spark, first, path)
    assert audit_tables.read_audit(spark, path).count() == 20

    table = audit_tables.read_audit(spark, path)
    assert audit_tables.merge_audit(spark, table.where("id <= 5"), copy) == 5
    assert audit_tables.merge_audit(spark, table, copy) == 15
    assert audit_tables.merge_audit(spark, table, copy) == 0
    clash = table.where("id = 1").withColumn("entry_hash", F.lit("0" * 64))
    with pytest.raises(audit_tables.IdConflict):
        audit_tables.merge_audit(spark, clash, copy)

    listed = audit.list_latest(table.withColumn("outcome", F.lit("edited")), 3).collect()
    assert [r.id for r in listed] == [18, 19, 20] and not any(r.hash_valid for r in listed)
    between = audit.audit_between(table, "2024-03-02T00:00:00Z", "2024-03-03T00:00:00Z")
    assert between.count() == 10


def test_list_length_is_held_in_range(spark):
    rows = audit.with_entry_hash(
        spark.createDataFrame([event(n) for n in range(3)], EVENT)
    ).withColumn("id", F.monotonically_increasing_id())
    assert audit.list_latest(rows, 0).count() == 1


def test_metrics_of_an_empty_table(spark):
    row = audit.audit_metrics(spark.createDataFrame([], audit.AUDIT_SCHEMA)).first()
    assert (row.total_entries, row.failure_count, row.by_action) == (0, 0, {})


def test_each_metadata_text_is_parsed_twice_only(spark):
    """The same canonical form as the column function gives, and no expression of it copied."""
    from scrubline.functions.canonical import with_canonical_json

    texts = ['{"b": 1, "a": [2, 3]}', '{"z": 12.0}', "[1", "1 2", "", None, '{"k": 1e7}', '{"a": 1, "a": 2}', "null", "[" * 200 + "]" * 200]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, metadata_json string")
    done = with_canonical_json(rows, "metadata_json", "out").withColumn("want", canonical_json(F.col("metadata_json")))
    assert all(r.out == r.want for r in done.collect())
    events = rows.select("metadata_json", *[F.lit("x").alias(c) for c in ("ts", "actor", "role", "action", "resource", "outcome")])
    plan = audit.with_entry_hash(events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 2
