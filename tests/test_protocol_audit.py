"""The audit of all groups of the events."""

from granary.plans.load import QUERIES


def test_every_user_is_audited(spark, tmp_path):
    rows = [(u, "view", 30.0) for u in range(100) for _ in range(200 if u in (0, 1) else 5)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["model"], r["problem"]) for r in QUERIES["protocol_audit"](spark, str(tmp_path)).collect()}
    want = {(f"view_{u}", p) for u in range(100) for p, bad in (("runs", u > 1), ("warmups", u > 1), ("hardware", u % 9 != 0)) if bad}
    assert got == want
