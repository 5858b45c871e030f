"""Confidence of pages from their ledger: sources, verifications, contradictions, decay, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.markdown import stable_id
from tessera.functions.text import clamp01, days_between, js_round

#: Base, penalties and their cap, boosts' cap, source scale, half-life and ceiling of a note.
START, MAJOR, MINOR, MOST_PENALTY, MOST_BOOST, SCALE, HALF_LIFE, CEILING = 0.25, 0.35, 0.10, 0.6, 0.25, 1.5, 120.0, 0.30
#: Days that a verification's boost lasts.
BOOST_DAYS = 30
#: Who verifies, by the whole id or what it begins with; the boost in hundredths and the days until the like resets decay again.
#: The first that fits counts. Others are an agent's or nobody's.
VERIFIERS = [
    ("human:*", "human", 5, 0),
    ("ci:github-actions", "ci:github-actions", 3, 14),
    ("ci:*", "ci:other", 2, 14),
    ("agent:claude-code", "agent:claude-code", 2, 7),
    ("agent:*", "agent:other", 1, 7),
    ("runbook-exec", "runbook-exec", 4, 0),
    ("test:integration", "test:integration", 4, 0),
    ("test:unit", "test:unit", 2, 14),
]
OTHERS = [("agent:other", 1, 7), ("unpatterned", 1, 7)]
#: Penalty of a superseded page and the most that its score can be.
SUPERSEDED, SUPERSEDED_MOST = 0.6, 0.3
#: Half-life in days and ceiling of decay by type of page; other types decay as a note.
PROFILES = {"decision": (365.0, 0.15), "architecture": (180.0, 0.20), "module": (90.0, 0.30), "concept": (730.0, 0.10), "runbook": (60.0, 0.40), "api": (60.0, 0.40), "meeting": (30.0, 0.50)}
_DAY = 86_400_000_000


def verifier(actor_id: Column, by_agent: Column) -> Column:
    """(who, boost, days) of a verification: boost in hundredths, days between two that reset decay."""
    rule = lambda who, boost, days: F.struct(F.lit(who).alias("who"), F.lit(boost).alias("boost"), F.lit(days).alias("days"))
    actor = F.coalesce(actor_id, F.lit(""))
    out = F.when(by_agent, rule(*OTHERS[0])).otherwise(rule(*OTHERS[1]))
    for name, *values in reversed(VERIFIERS):
        out = F.when(actor.startswith(name[:-1]) if name.endswith("*") else actor == name, rule(*values)).otherwise(out)
    return out


def state(ledger: DataFrame, now: Column, page_types: DataFrame | None = None) -> DataFrame:
    """Per page: score, its parts, counts, last_verified_at and the anchor of decay as seconds, superseded.

    A ledger with overrides has a column new_base, one that says whether an agent verified verifier_type. page_types has
    (page_id, page_type); without it all pages are notes. Events later than `now` count as of now. `now` is a time, or a
    column of the ledger that is the same in all rows of a page.
    """
    ledger = ledger.withColumn("as_of", now)
    facts = _facts(ledger, page_types)
    score, strength, penalty, decay, boost, anchor = _score("as_of", "boost")
    seconds = lambda c: F.floor(c / 1_000_000).cast("long")
    return facts.select(
        "page_id",
        js_round(score, 4).alias("score"),
        js_round(strength, 4).alias("source_strength"),
        js_round(penalty, 4).alias("contradiction_penalty"),
        js_round(decay, 4).alias("time_decay"),
        js_round(boost, 4).alias("verification_boost"),
        F.coalesce("source_count", F.lit(0)).cast("long").alias("source_count"),
        (F.col("majors") + F.col("minors")).alias("contradiction_count"),
        seconds(F.col("last_verified")).alias("last_verified_at"),
        seconds(anchor).alias("anchor"),
        (F.col("superseded") > 0).alias("superseded"),
    )


def _facts(ledger: DataFrame, page_types: DataFrame | None, ends: DataFrame | None = None) -> DataFrame:
    """Per page what its ledger, which has a column as_of, says: weights, counts, last times, the boost as of then and, with `ends` (page_id, last_at), at the last event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    verified = F.col("kind") == "verified"
    # sources: the last weight of each that was not removed since, then their sum
    last = F.max_by(F.struct((F.col("kind") == "source_added").alias("there"), F.col("source_weight").alias("w")), F.struct("ts", "seq"))
    weights = (
        ledger.where("kind in ('source_added', 'source_removed')").groupBy("page_id", "source_id").agg(last.alias("last")).where("last.there").select("page_id", "last.w")
        .groupBy("page_id").agg(F.sum("w").alias("weight"), F.count("*").alias("source_count"))
    )
    # a verification resets the anchor when the last one of its kind that did is old enough; one time per value is enough
    by_agent = F.coalesce(F.col("verifier_type") == "agent", F.lit(False)) if "verifier_type" in ledger.columns else F.lit(False)
    rules = ledger.where(verified).select("page_id", at.alias("at"), "ts", "as_of", verifier(F.col("actor_id"), by_agent).alias("rule")).select("page_id", "at", "ts", "as_of", "rule.*")
    lasting = lambda t: F.sum(F.when(days_between(F.col("ts"), F.col(t)) <= BOOST_DAYS, F.col("boost")).otherwise(0))
    boosted, then = (rules, []) if ends is None else (rules.join(ends, "page_id"), [lasting("last_at").alias("boost_at_last")])
    boosts = boosted.groupBy("page_id").agg(lasting("as_of").alias("boost"), *then, F.max(F.when(F.col("days") == 0, F.col("at"))).alias("last_free"))
    spaced = rules.where("days > 0").select("page_id", "who", "days", "at").distinct().groupBy("page_id", "who", "days").agg(F.array_sort(F.collect_list("at")).alias("times"))
    reset = F.aggregate("times", F.lit(None).cast("long"), lambda a, x: F.when(a.isNull() | (x - a >= F.col("days") * F.lit(_DAY)), x).otherwise(a))
    resets = spaced.select("page_id", reset.alias("at")).groupBy("page_id").agg(F.max("at").alias("last_spaced"))
    overrides = F.col("kind") == "manual_override"
    base = F.max_by("new_base", F.when(overrides, F.struct("ts", "seq"))) if "new_base" in ledger.columns else F.lit(None).cast("double")
    sums = ledger.groupBy("page_id").agg(
        F.max(F.when(~F.col("kind").isin("source_added", "source_removed", "verified"), at)).alias("last_other"),
        F.max(at).alias("last_event"),
        F.count_if(F.col("severity") == "major").alias("majors"),
        F.count_if(F.col("severity") == "minor").alias("minors"),
        F.count_if(F.col("kind") == "superseded_by").alias("superseded"),
        base.alias("base"),
        F.max("as_of").alias("as_of"),
        F.max("ts").alias("last_at"),
        F.max(F.when(F.col("kind") == "decay_checkpoint", F.col("ts"))).alias("checkpoint_at"),
    )
    all_of = sums.join(weights, "page_id", "left").join(boosts, "page_id", "left").join(resets, "page_id", "left").withColumn("last_verified", F.greatest("last_free", "last_spaced"))
    if page_types is None:
        return all_of.withColumn("page_type", F.lit(None).cast("string"))
    return all_of.join(page_types.select("page_id", "page_type"), "page_id", "left")


def _score(as_of: str, boosts: str) -> tuple[Column, ...]:
    """(score, strength, penalty, decay, boost, anchor) of rows of _facts, by its columns of a time and of the boosts that last until then."""
    half_life, ceiling = F.lit(HALF_LIFE), F.lit(CEILING)
    for name, (days, most) in PROFILES.items():
        half_life = F.when(F.col("page_type") == name, days).otherwise(half_life)
        ceiling = F.when(F.col("page_type") == name, most).otherwise(ceiling)
    anchor = F.coalesce(F.greatest("last_verified", "last_other"), F.col("last_event"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.col(as_of).cast("timestamp")) - anchor) / F.lit(float(_DAY)))
    strength = 1 - F.exp(-F.coalesce("weight", F.lit(0.0)) / SCALE)
    penalty = F.least(F.lit(MOST_PENALTY), F.col("majors") * MAJOR + F.col("minors") * MINOR + F.col("superseded") * SUPERSEDED)
    boost = F.least(F.lit(MOST_BOOST), F.coalesce(boosts, F.lit(0)) / 100)
    decay = (1 - F.pow(F.lit(2.0), -age / half_life)) * ceiling
    score = clamp01(F.coalesce("base", F.lit(START)) + strength - penalty - decay + boost)
    score = F.when(F.col("superseded") > 0, F.least(score, F.lit(SUPERSEDED_MOST))).otherwise(score)
    return score, strength, penalty, decay, boost, anchor


def freshness(ledger: DataFrame, now: Column) -> DataFrame:
    """Per page: freshness and access recency, which halve in their own times, from its last event."""
    days = days_between(F.max("ts"), now)
    return ledger.groupBy("page_id").agg(js_round(F.exp(-days / 180), 4).alias("freshness"), js_round(F.exp(-days / 30), 4).alias("access_recency"))


def contradictions(ledger: DataFrame) -> DataFrame:
    """Contradictions of a page that no later verification or supersession settled, and the last major one, in seconds."""
    settled = ledger.where("kind in ('verified', 'superseded_by')").groupBy("page_id").agg(F.max(F.struct("ts", "seq")).alias("v"))
    rows = ledger.where("kind = 'contradicted_by'").join(settled, "page_id", "left").where(F.col("v").isNull() | (F.struct("ts", "seq") > F.col("v")))
    seconds = F.floor(F.unix_micros(F.max(F.when(F.col("severity") == "major", F.col("ts"))).cast("timestamp")) / 1_000_000).cast("long")
    return rows.groupBy("page_id").agg(F.count("*").alias("active"), seconds.alias("latest_major"))


def latest_major(ledger: DataFrame) -> DataFrame:
    """(page_id, major_at): a page's last major contradiction, settled or not."""
    return ledger.where("kind = 'contradicted_by' and severity = 'major'").groupBy("page_id").agg(F.max("ts").alias("major_at"))


def rank_flags(now: Column) -> Column:
    """Flags of a result that is not superseded: below .5, a major contradiction in the last 30 days, not verified for 240 days."""
    verified = (F.unix_micros(now.cast("timestamp")) / 1e6 - F.col("last_verified_at")) / 86400
    found = F.array(
        F.when(F.col("confidence") < 0.5, "NEEDS_REVIEW"), F.when(F.col("major_at").isNotNull() & (days_between(F.col("major_at"), now) <= 30), "RECENTLY_CONTRADICTED"), F.when(verified > 240, "STALE")
    )
    return F.array_compact(found)


#: Days between two checkpoints, and scores whose crossing downwards is one sooner.
CHECKPOINT_DAYS, THRESHOLDS = 14, (0.7, 0.5, 0.3)


def decay_checkpoints(ledger: DataFrame, now: str, page_types: DataFrame | None = None) -> DataFrame:
    """Ledger lines to add for pages whose last checkpoint is 14 days old or missing, or whose score fell below a threshold since their last event.

    (id, page_id, ts, kind, days_since_last_event, applied_decay). When they are added, the same call gives none.
    """
    then = F.lit(now).cast("timestamp_ntz")
    last = ledger.groupBy("page_id").agg(F.max("ts").alias("last_at"))
    # the ledger is folded once; the two scores differ in their time and the boosts that last until then
    facts = _facts(ledger.withColumn("as_of", then), page_types, last)
    before, after = (js_round(_score(*at)[0], 4) for at in (("last_at", "boost_at_last"), ("as_of", "boost")))
    rows = facts.select("page_id", "last_at", "checkpoint_at", before.alias("before"), after.alias("after"))
    crossed = F.lit(False)
    for threshold in THRESHOLDS:
        crossed = crossed | ((F.col("before") >= threshold) & (F.col("after") < threshold))
    due = F.col("checkpoint_at").isNull() | (days_between(F.col("checkpoint_at"), then) >= CHECKPOINT_DAYS)
    name = F.concat("page_id", F.lit(":decay:"), F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return rows.where(due | crossed).select(
        stable_id(name, "evt").alias("id"), "page_id", then.alias("ts"), F.lit("decay_checkpoint").alias("kind"), days_between(F.col("last_at"), then).alias("days_since_last_event"),
        js_round(F.greatest(F.lit(0.0), F.col("before") - F.col("after")), 4).alias("applied_decay"),
    )


def united(ledger: DataFrame, projected: DataFrame) -> DataFrame:
    """Lines of the ledger and of its projection; a line that both have, by page and number, counts once, as the ledger has it."""
    return ledger.unionByName(projected.join(ledger.select("page_id", "seq"), ["page_id", "seq"], "left_anti").select(ledger.columns))


def freshest(ledger: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """(page_id, score, last_event_at, folded): the stored state of a page unless its ledger is newer, and then a new one.

    stored: (page_id, score, last_event_at). Only ledgers that are newer are folded; a stored page without a ledger stays.
    """
    last = ledger.groupBy("page_id").agg(F.max("ts").alias("ledger_at"))
    both = last.join(stored.select("page_id", "score", "last_event_at"), "page_id", "full_outer")
    newer = F.col("ledger_at").isNotNull() & (F.col("last_event_at").isNull() | (F.col("ledger_at") > F.col("last_event_at")))
    marked = both.withColumn("folded", newer)
    fresh = state(ledger.join(marked.where("folded").select("page_id"), "page_id", "left_semi"), now).select("page_id", F.col("score").alias("fresh"))
    rows = marked.join(fresh, "page_id", "left")
    return rows.select("page_id", F.when(F.col("folded"), F.col("fresh")).otherwise(F.col("score")).alias("score"), F.when(F.col("folded"), F.col("ledger_at")).otherwise(F.col("last_event_at")).alias("last_event_at"), "folded")
