"""The ledger's fold on kinds of events that the tables never make."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import confidence

COLUMNS = "page_id string, seq long, ts timestamp_ntz, kind string, actor_id string, severity string, source_id string, source_weight double, new_base double"
NOW = datetime.datetime(2024, 2, 1)


def line(page, seq, kind, source=None, weight=None, base=None):
    return (page, seq, NOW, kind, None, None, source, weight, base)


def states(spark, rows, types=None):
    found = confidence.state(spark.createDataFrame(rows, COLUMNS), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), types)
    return {r["page_id"]: r for r in found.collect()}


def test_removed_sources_overrides_and_superseded_pages(spark):
    rows = [line("gone", 1, "source_added", "a", 1.0), line("gone", 2, "source_removed", "a")]
    rows += [line("back", 1, "source_added", "a", 1.0), line("back", 2, "source_removed", "a"), line("back", 3, "source_added", "a", 0.0)]
    rows += [line("set", 1, "manual_override", base=0.9), line("set", 2, "manual_override", base=0.4)]
    rows += [line("old", 1, "manual_override", base=1.0), line("old", 2, "source_added", "a", 1.5), line("old", 3, "superseded_by")]
    found = states(spark, rows)
    assert {p: (r["score"], r["source_count"], r["contradiction_penalty"]) for p, r in found.items()} == {
        "gone": (0.25, 0, 0.0), "back": (0.25, 1, 0.0), "set": (0.4, 0, 0.0), "old": (0.3, 1, 0.6),
    }


def test_decay_by_type_of_page(spark):
    rows = [(p, 1, NOW - datetime.timedelta(days=60), "decay_checkpoint", None, None, None, None, None) for p in ("run", "note")]
    found = states(spark, rows, spark.createDataFrame([("run", "runbook"), ("note", "note")], "page_id string, page_type string"))
    assert (found["run"]["time_decay"], found["note"]["time_decay"]) == (0.2, 0.0879)


#: Who verifies, and then boost and days between resets.
RULES = {
    "human:a": ("human", 0.05, 0), "human:b": ("human", 0.05, 0), "ci:github-actions": ("gh", 0.03, 14), "ci:x": ("ci", 0.02, 14), "ci:y": ("ci", 0.02, 14), "agent:claude-code": ("cc", 0.02, 7), "agent:z": ("agent", 0.01, 7),
    "runbook-exec": ("run", 0.04, 0), "test:integration": ("ti", 0.04, 0), "test:unit": ("tu", 0.02, 14), "test:other": ("none", 0.01, 7), None: ("none", 0.01, 7), "bot": ("none", 0.01, 7),
}


def fold(events):
    """One page's state, event by event."""
    import math

    events = sorted(events, key=lambda e: (e["ts"], e["seq"]))
    days = lambda a, b: max(0, (b - a).total_seconds() / 86400)
    weights, penalty, count, boost, base, superseded, verified, resets, anchor = {}, 0, 0, 0, 0.25, False, None, {}, events[-1]["ts"]
    for e in events:
        kind, ts = e["kind"], e["ts"]
        if kind == "source_added":
            weights[e["source_id"]] = e["source_weight"]
        elif kind == "source_removed":
            weights.pop(e["source_id"], None)
        elif kind == "verified":
            who, value, window = RULES[e["actor_id"]]
            if who == "none" and e["verifier_type"] == "agent":
                who = "agent"
            if days(ts, NOW) <= 30:
                boost += value
            if who not in resets or days(resets[who], ts) >= window:
                verified = anchor = resets[who] = ts
        else:
            anchor = ts
            count += kind == "contradicted_by"
            penalty += {"contradicted_by": 0.35 if e["severity"] == "major" else 0.1, "superseded_by": 0.6}.get(kind, 0)
            superseded |= kind == "superseded_by"
            base = e["new_base"] if kind == "manual_override" else base
    penalty, boost = min(0.6, penalty), min(0.25, boost)
    strength, decay = 1 - math.exp(-sum(weights.values()) / 1.5), (1 - 2 ** (-days(anchor, NOW) / 120)) * 0.3
    score = max(0, min(1, base + strength - penalty - decay + boost))
    return (min(score, 0.3) if superseded else score), boost, penalty, decay, len(weights), count, verified, anchor, superseded


def test_random_ledgers_equal_the_fold(spark):
    import random

    import pytest

    r = random.Random(11)
    kinds = ["source_added", "source_removed", "verified", "verified", "verified", "contradicted_by", "decay_checkpoint", "manual_override", "superseded_by"]
    rows, pages = [], {}
    for p in range(300):
        for seq in range(r.randint(1, 14)):
            kind = r.choice(kinds[: r.choice([3, 5, 7, 9])])
            e = {"page_id": f"p{p}", "seq": seq, "ts": NOW - datetime.timedelta(hours=r.choice([-24, 0, 1, 7 * 24, r.randint(0, 2000)])), "kind": kind, "actor_id": None, "verifier_type": None, "severity": None, "source_id": None, "source_weight": None, "new_base": None}
            if kind == "verified":
                e["actor_id"], e["verifier_type"] = r.choice(list(RULES)), r.choice(["agent", "human", None])
            elif kind == "contradicted_by":
                e["severity"] = r.choice(["major", "minor"])
            elif kind.startswith("source"):
                e["source_id"], e["source_weight"] = r.choice("abc"), r.random() if kind == "source_added" else None
            elif kind == "manual_override":
                e["new_base"] = r.random()
            rows.append(e)
            pages.setdefault(e["page_id"], []).append(e)
    table = spark.createDataFrame([tuple(e.values()) for e in rows], "page_id string, seq long, ts timestamp_ntz, kind string, actor_id string, verifier_type string, severity string, source_id string, source_weight double, new_base double")
    found = confidence.state(table, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).collect()
    assert len(found) == len(pages)
    seconds = lambda t: None if t is None else int(t.replace(tzinfo=datetime.timezone.utc).timestamp())
    for s in found:
        score, boost, penalty, decay, sources, count, verified, anchor, superseded = fold(pages[s["page_id"]])
        assert (s["score"], s["verification_boost"], s["contradiction_penalty"], s["time_decay"]) == pytest.approx((score, boost, penalty, decay), abs=6e-5)
        assert (s["source_count"], s["contradiction_count"], s["last_verified_at"], s["anchor"], s["superseded"]) == (sources, count, seconds(verified), seconds(anchor), superseded)


def test_decay_checkpoints_once(spark):
    import pytest

    day = datetime.timedelta(days=1)
    old = lambda p, seq, days, kind, **more: (p, seq, NOW - days * day, kind, None, None, more.get("source"), more.get("weight"), more.get("base"))
    rows = [old("never", 1, 1, "manual_override", base=0.6), old("recent", 1, 13, "decay_checkpoint"), old("due", 1, 14, "decay_checkpoint"), old("due", 2, 2, "source_added", source="a", weight=0.0)]
    rows += [old("crossed", 1, 10, "decay_checkpoint"), old("crossed", 2, 10, "manual_override", base=0.51)]
    ledger = spark.createDataFrame(rows, COLUMNS)
    found = {r["page_id"]: r for r in confidence.decay_checkpoints(ledger, str(NOW)).collect()}
    assert set(found) == {"never", "due", "crossed"}
    assert found["crossed"]["days_since_last_event"] == 10 and found["crossed"]["applied_decay"] == pytest.approx(0.3 * (1 - 2 ** (-10 / 120)), abs=1e-3)
    added = [(p, 99, NOW, "decay_checkpoint", None, None, None, None, None) for p in found]
    assert confidence.decay_checkpoints(ledger.unionByName(spark.createDataFrame(added, COLUMNS)), str(NOW)).collect() == []


def test_freshest_and_united(spark):
    rows = [line("old", 1, "manual_override", base=0.9), line("new", 1, "manual_override", base=0.9), line("fresh", 1, "manual_override", base=0.8)]
    ledger = spark.createDataFrame(rows, COLUMNS)
    day = datetime.timedelta(days=1)
    stored = spark.createDataFrame([("old", 0.1, NOW), ("new", 0.1, NOW - day), ("alone", 0.4, NOW)], "page_id string, score double, last_event_at timestamp_ntz")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    found = {r["page_id"]: (r["score"], r["folded"]) for r in confidence.freshest(ledger, stored, now).collect()}
    assert found == {"old": (0.1, False), "new": (0.9, True), "alone": (0.4, False), "fresh": (0.8, True)}
    projected = spark.createDataFrame([line("old", 1, "manual_override", base=0.2), line("old", 2, "source_added", "a", 0.0)], COLUMNS)
    both = confidence.united(ledger, projected)
    assert both.count() == 4 and both.where("page_id = 'old' and seq = 1").first()["new_base"] == 0.9


def test_decay_checkpoints_fold_the_ledger_once(spark):
    """Both scores come from one fold, and are those of two."""
    import random

    r = random.Random(15)
    rows = []
    for p in range(60):
        for seq in range(r.randint(1, 9)):
            kind = r.choice(["source_added", "verified", "verified", "contradicted_by", "manual_override"])
            ts = NOW - datetime.timedelta(hours=r.randint(0, 4000))
            rows.append((f"p{p}", seq, ts, kind, r.choice(list(RULES)) if kind == "verified" else None, "minor" if kind == "contradicted_by" else None, "s" if kind == "source_added" else None, 1.0 if kind == "source_added" else None, 0.7 if kind == "manual_override" else None))
    ledger = spark.createDataFrame(rows, COLUMNS)
    types = spark.createDataFrame([(f"p{p}", ["runbook", "note", "api"][p % 3]) for p in range(0, 60, 2)], "page_id string, page_type string")
    found = confidence.decay_checkpoints(ledger, str(NOW), types)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    then = F.lit(str(NOW)).cast("timestamp_ntz")
    last = ledger.groupBy("page_id").agg(F.max("ts").alias("last_at"))
    before = {x["page_id"]: x["score"] for x in confidence.state(ledger.join(last, "page_id"), F.col("last_at"), types).collect()}
    after = {x["page_id"]: x["score"] for x in confidence.state(ledger, then, types).collect()}
    assert {x["page_id"]: x["applied_decay"] for x in found.collect()} == {p: round(max(0.0, before[p] - after[p]), 4) for p in before}
