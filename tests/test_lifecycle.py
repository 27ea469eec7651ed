"""Status of findings: the truth table of its sources, decisions, relapse, consensus."""

import itertools
from datetime import datetime

from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators import lifecycle

T = [datetime(2026, 1, d) for d in range(1, 10)]


def test_status_truth_table(spark):
    """All combinations of global decision, own decision, running review, verdict and later sighting."""
    options = list(itertools.product([None, "done", "obsolete", "open"], [None, "done", "open"], [False, True], [None, "confirmed"], [False, True]))
    findings, decisions, running, runs, seen = [], [], [], [], []
    for i, (world, own, run, verdict, later) in enumerate(options):
        g = f"g{i}"
        findings.append((g, "s"))
        decisions += [(g, None, world, T[1])] if world else []
        decisions += [(g, "s", own, T[2])] if own else []
        running += [(g, "s")] if run else []
        runs += [(g, "s", verdict, T[0])] if verdict else []
        seen.append((g, "s", T[3] if later else T[0], 2))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = lifecycle.statuses(
        df(findings, "signature string, session_id string"), df(decisions, "signature string, session_id string, status string, decided_at timestamp"), df(running, "signature string, session_id string"),
        df(runs, "signature string, session_id string, result string, started_at timestamp"), df(seen, "signature string, session_id string, seen_at timestamp, hits int"))
    got = {r.signature: r.status for r in out.collect()}
    assert len(got) == len(options) and set(got.values()) <= set(S.STATUS_RANK)
    for i, (world, own, run, verdict, later) in enumerate(options):
        effective = own or world
        if effective in ("done", "obsolete"):
            expected = "relapse" if effective == "done" and world == "done" and later else effective
        else:
            expected = "in_review" if run else verdict or "open"
        assert got[f"g{i}"] == expected, options[i]


def test_group_status_and_reconcile(spark):
    df = spark.createDataFrame([("a", "open"), ("a", "dissent"), ("b", "obsolete"), ("b", "done")], "g string, status string")
    assert {r.g: r.status for r in lifecycle.group_status(df, ["g"]).collect()} == {"a": "dissent", "b": "done"}
    pairs = [("yes", None), ("no", None), ("unclear", None), ("yes", "yes"), ("no", "no"), ("yes", "no"), ("unclear", "unclear")]
    v = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lifecycle.reconcile(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in v.collect()] == ["confirmed", "rejected", "rejected", "confirmed", "rejected", "dissent", "dissent"]


def test_ties_close(spark):
    d = spark.createDataFrame([("g", None, "open", T[1]), ("g", None, "done", T[1])], "signature string, session_id string, status string, decided_at timestamp")
    f = spark.createDataFrame([("g", "s")], "signature string, session_id string")
    assert lifecycle.open_findings(f, d).count() == 0


def test_consensus_and_anchor(spark):
    a = spark.createDataFrame([(1, "yes", "Wrong path!"), (2, "yes", "different"), (3, "unclear", "x"), (4, "yes", "abc")], "k int, verdict string, category string")
    b = spark.createDataFrame([(1, "yes", "wrong  paths"), (2, "yes", "utterly different"), (3, "unclear", "x")], "k int, verdict string, category string")
    assert [r.result for r in lifecycle.consensus(a, b, ["k"]).orderBy("k").collect()] == ["yes", "yes", "dissent", "single"]
    d = spark.createDataFrame([("p", "My Section"), ("p", "gone"), ("q", "x"), (None, None)], "path string, section string")
    files = spark.createDataFrame([("p", "... my SECTION ...")], "path string, content string")
    assert sorted((str(r.section), r.anchored) for r in lifecycle.anchors(d, files).collect()) == [("My Section", True), ("None", True), ("gone", False), ("x", False)]
