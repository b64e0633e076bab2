"""The gate, access review and reply classification on small tables."""

import datetime
import json
from pathlib import Path

from pyspark.sql import functions as F

from scrubline.functions.policy import policy_reason
from scrubline.functions.prompts import REFUSAL_BODY, reply_error, reply_outcome, strip_tokens
from scrubline.operators import access, gate
from scrubline.plans import queries
from scrubline.sources.requests import REQUEST_SCHEMA, fill_skill, read_scenarios
from scrubline.session import scratch_path


def request(n, prompt, skill=None, error=None, status=None, body=None, audit_error=None):
    return (n, "2024-01-01T00:00:00Z", "a", "operator", prompt, skill, "m", error, status, body, audit_error, 1.005)


REQUESTS = [
    request(1, "clean summary"),
    request(2, "patient SSN 123-45-6789"),
    request(3, "clean", "other"),
    request(4, "é" * 2001),
    request(5, "clean", "s" * 65),
    request(6, "Sex: F", error="api", status=402, body="credit balance too low"),
    request(7, "clean", error="empty"),
    request(8, "clean", error="not_configured"),
    request(9, "clean", audit_error="disk full"),
]


def decide(spark, **options):
    rows = fill_skill(spark.createDataFrame(REQUESTS, REQUEST_SCHEMA))
    decided = gate.audit_metadata(gate.detail(gate.status_code(gate.gate(rows, **options))))
    return {r.request_id: r for r in decided.collect()}


def test_decisions(spark):
    rows = decide(spark)
    assert {n: r.status for n, r in rows.items()} == {
        1: 200, 2: 403, 3: 403, 4: 400, 5: 400, 6: 400, 7: 502, 8: 503, 9: 500,
    }
    assert rows[2].detail == "request blocked by policy: phi_pattern_detected"
    assert rows[4].detail == "api error (400): prompt exceeds 4000 characters"
    assert rows[2].scrubbed == "" and rows[6].scrubbed == "[REDACTED-SEX]"
    assert rows[4].metadata_json is None
    blocked = json.loads(rows[2].metadata_json)
    assert blocked["deid_prompt_len"] == 0 and blocked["policy_reason"] == "phi_pattern_detected"
    assert '"model":null' in rows[6].metadata_json
    for row in rows.values():
        if row.metadata_json:
            assert list(json.loads(row.metadata_json)) == sorted(json.loads(row.metadata_json))


def test_fallback_serves_billing_errors(spark):
    row = decide(spark, fallback_stub=True)[6]
    assert (row.status, row.outcome, row.model) == (200, "ok", "stub-fallback")


def test_no_model_is_called_when_it_is_off(spark):
    rows = decide(spark, model_off=True)
    for n in (1, 6, 7, 8):
        assert (rows[n].status, rows[n].outcome, rows[n].model, rows[n].detail) == (200, "ok", "stub", None)
    assert (rows[2].status, rows[2].model, rows[4].status) == (403, None, 400)


def test_refused_reply_is_an_error(spark):
    outcomes = spark.createDataFrame([("refused",), ("ok",)], "outcome string")
    got = {r.outcome: r.e for r in outcomes.withColumn("e", reply_error(F.col("outcome"))).collect()}
    assert got["ok"] is None
    error = got["refused"]
    rows = fill_skill(spark.createDataFrame(
        [request(1, "clean", error=error.model_error, status=error.upstream_status, body=error.upstream_body)], REQUEST_SCHEMA
    ))
    row = gate.detail(gate.status_code(gate.gate(rows))).first()
    assert (row.status, row.detail) == (502, f"api error (422): {REFUSAL_BODY}")
    row = gate.status_code(gate.gate(rows, fallback_stub=True)).first()
    assert (row.status, row.model) == (200, "stub-fallback")


def test_policy_cases(spark):
    cases = [("a SSN 123-45-6789", "vault-answer", "phi_pattern_detected"),
             ("Age: 67 | MRN: HIDDEN", "vault-answer", None), ("x", "unknown", "skill_not_allowed")]
    df = spark.createDataFrame(cases, "prompt string, skill string, want string")
    for row in df.withColumn("got", policy_reason(F.col("skill"), F.col("prompt"))).collect():
        assert row.got == row.want


def test_scenarios(spark):
    path = scratch_path(spark, "scenario") + ".json"
    document = {"title": "t", "scenarios": [
        {"id": "a", "label": "A", "skill": "vault-answer", "context": "c", "question": "q"},
        {"id": "b", "label": "B", "context": "c", "question": "SSN 123-45-6789", "expect_blocked": True}]}
    with open(path, "w") as out:
        json.dump(document, out, indent=2)
    rows = read_scenarios(spark, path).withColumn("reason", policy_reason(F.col("skill"), F.col("prompt"))).collect()
    assert rows[0].prompt == "CONTEXT:\nc\n\nQUESTION:\nq"
    assert [r.reason is not None for r in rows] == [r.expect_blocked for r in rows]


def test_claims(spark):
    schema = ("sub string, email string, preferred_username string, groups array<string>, "
              "realm_access struct<roles: array<string>>")
    claims = [("u1", "op@ward.test", None, [], (["ops"],)), ("u2", None, "name", ["aud", "ops"], None),
              ("u3", None, None, None, (["aud"],)), ("u4", None, None, None, None)]
    rows = access.review_claims(spark.createDataFrame(claims, schema), ["ops"], ["aud"]).collect()
    assert [(r.role, r.actor) for r in rows] == [
        ("operator", "op@ward.test"), ("operator", "name"), ("auditor", "u3"), (None, "u4"),
    ]


def test_strip_tokens_keeps_what_it_should(spark):
    text = "de-identified  lab panel \n | [REDACTED-NAME] x | \n\n[REDACTED-PLAN-ID] [AGE-90+]\n[REDACTED-SSN]"
    row = spark.createDataFrame([(text,)], "t string").select(strip_tokens(F.col("t")).alias("s")).first()
    assert row.s == "Practice case\nx\n[REDACTED-PLAN-ID] [AGE-90+]"


def test_reply_outcomes(spark):
    rows = [("llama", "fine", None, "ok"), ("llama", "I cannot provide", None, "retry"),
            ("llama", "I cannot provide", "fine", "ok_after_retry"),
            ("llama", "I cannot provide", "Sensitive.", "refused"), ("MedGemma", "I cannot provide", "fine", "refused")]
    df = spark.createDataFrame(rows, "m string, a string, b string, want string")
    for row in df.withColumn("got", reply_outcome(F.col("m"), F.col("a"), F.col("b"))).collect():
        assert row.got == row.want


def test_errors_without_a_body_or_status_still_say_what_happened(spark):
    rows = [request(1, "ok", error="http"), request(2, "ok", error="api", status=502), request(3, "ok", error="api")]
    decided = gate.gate(fill_skill(spark.createDataFrame(rows, REQUEST_SCHEMA)))
    found = {r.request_id: r for r in gate.audit_metadata(gate.detail(decided)).collect()}
    assert [found[k].detail for k in (1, 2, 3)] == ["http error: ", "api error (502): ", "api error (unknown): "]
    assert '"error":"api error (502): "' in found[2].metadata_json


def test_streamed_requests_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    day = datetime.datetime(2024, 1, 5)
    rows = [(k, k % 7, day, "1-URGENT") for k in range(200)] + [(3, 3, day, None), (None, 1, day, None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    found = queries.stream_gate(spark, str(tmp_path))
    assert sorted(str(r["request_id"]) for r in found.collect()) == sorted(str(k) for k, *_ in rows)
    assert len(list(Path(tmp_path, "requests").glob("*.parquet"))) > 1
