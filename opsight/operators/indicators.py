"""Enterprise indicators (IND-0, IND-00 and the row-level indicators of ENT 1.1-14.4).

Each indicator aggregates row-level input over a window ending at `as_of`,
optionally grouped by keys, and returns value + status via the common status
rule (IND-0). Text indicators (QA phrases, disclosures, card numbers) scan
whole texts with JVM regex functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import DAY, HOUR, count_if, ladder, mmss, neighbour_within, pct, r4, rnd, sessionize, since, ts_text
from ..functions.segments import asof_last, segmented, with_run_start
from ..functions.selection import exact_percentiles, with_percentiles
from ..functions.stats import luhn_ok


NO_DATA = "No Data"


# --------------------------------------------------------------------------- IND-0
def status(value: Column, target: float, critical: float, higher_is_better: bool = True, inclusive: bool = False) -> Column:
    """Healthy within the target, Critical beyond the critical limit, At Risk between the two.

    A target of an indicator that should be high includes the target itself; one that should be low
    excludes it unless `inclusive`. A null value (nothing measured in the window) is No Data, never Healthy.
    """
    none = (value.isNull(), NO_DATA)
    if higher_is_better:
        return ladder([none, (value < critical, "Critical"), (value < target, "At Risk")], "Healthy")
    beyond = value > target if inclusive else value >= target
    return ladder([none, (value > critical, "Critical"), (beyond, "At Risk")], "Healthy")


# --------------------------------------------------------------------------- IND-00
def escalation(status_series: DataFrame, key: str, ts: str = "ts", st: str = "status",
               unit_s: int = 60, segment_s: float | None = None) -> DataFrame:
    """Duration-based escalation: how long the current status has lasted (runs of equal
    status), then the escalation matrix: At Risk > 15 / > 30; Critical now / > 15 / > 30.

    The series is cut into segments of `segment_s` (default 100 units), which carry in when the status began.
    """
    rows = segmented(status_series.select(key, ts, st), ts, segment_s or 100 * unit_s)
    s = with_run_start(rows, [key], [ts], st, "_start")
    dur = (F.unix_timestamp(ts) - F.unix_timestamp("_start")) / F.lit(unit_s)
    act = ladder([
        ((F.col(st) == "Critical") & (dur > 30), "Executive notification"),
        ((F.col(st) == "Critical") & (dur > 15), "Bridge call initiated"),
        (F.col(st) == "Critical", "Alert Operations Manager + Page On-call"),
        ((F.col(st) == "At Risk") & (dur > 30), "Alert Operations Manager"),
        ((F.col(st) == "At Risk") & (dur > 15), "Alert Team Lead")], "None")
    return s.select(key, ts_text(ts).alias(ts), st, r4(dur).alias("status_duration"), act.alias("escalation"))


# --------------------------------------------------------------------------- IND-1.4 / IND-8.4
def active_major_incidents(incidents: DataFrame, as_of: Column, velocity_s: int = DAY, target: int = 3, critical: int = 5) -> DataFrame:
    """Open P1/P2 incidents at as_of, by priority total, and new P1/P2 in the last velocity window."""
    o = incidents.filter(F.col("priority").isin(1, 2) & (F.col("opened_at") <= as_of))
    g = o.agg(count_if(F.col("state") != "Resolved").alias("active_p1_p2"),
              count_if((F.col("state") != "Resolved") & (F.col("priority") == 1)).alias("active_p1"),
              count_if(since("opened_at", as_of, velocity_s)).alias("new_in_window"),
              F.sum(F.when(F.col("state") != "Resolved", F.col("impact_value"))).alias("impact_value"))
    return g.select("active_p1_p2", "active_p1", "new_in_window", r4("impact_value").alias("impact_value"),
                    status(F.col("active_p1_p2").cast("double"), float(target), float(critical), higher_is_better=False, inclusive=True).alias("status"))


def security_incidents_24h(incidents: DataFrame, as_of: Column, window_s: int = DAY) -> DataFrame:
    """IND-8.4: P1 and P2 opened in the 24 h before as_of; any P1 is Critical, a P2 alone is Warning."""
    n = incidents.filter(since("opened_at", as_of, window_s) & (F.col("opened_at") <= as_of)).agg(
        count_if(F.col("priority") == 1).alias("p1_24h"), count_if(F.col("priority") == 2).alias("p2_24h"))
    return n.withColumn("status", ladder([(F.col("p1_24h") > 0, "Critical"), (F.col("p2_24h") > 0, "Warning")], "Healthy"))


# --------------------------------------------------------------------------- IND-3.x (voice)
def mos_weighted(calls: DataFrame, as_of: Column, window_s: int = 30 * DAY, keys=("region",)) -> DataFrame:
    """IND-3.1: duration-weighted MOS and the exact 10th percentile, by keys with a total (rollup)."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.rollup(*keys).agg((F.sum(F.col("mos") * F.col("duration_min")) / F.sum("duration_min")).alias("mos_weighted"),
                            F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("_gid"))
    # The rows of each total, for the percentile: _gid has a bit for every key that is summed over.
    n = len(keys)
    totals = c.withColumn("_gid", F.explode(F.array(*[F.lit((1 << j) - 1).cast("long") for j in range(n + 1)])))
    rolled = totals.select(*[F.when(F.col("_gid").bitwiseAND(1 << (n - 1 - i)) == 0, F.col(k)).alias(k) for i, k in enumerate(keys)], "_gid", "mos")
    g = with_percentiles(g, rolled, [*keys, "_gid"], "mos", {"mos_p10": 0.10})
    return g.select(*[F.coalesce(F.col(k), F.lit("ALL")).alias(k) for k in keys], r4("mos_weighted").alias("mos_weighted"),
                    r4("mos_p10").alias("mos_p10"), "calls", status(r4("mos_weighted"), 4.0, 3.6).alias("status"))


def poor_call_rate(calls: DataFrame, as_of: Column, window_s: int = 30 * DAY, keys=()) -> DataFrame:
    """IND-3.2: share of calls with MOS < 3.5 (2 decimals, as in the stated SQL), with quality bands."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = (c.groupBy(*keys) if keys else c.groupBy()).agg(
        count_if(F.col("mos") < 3.5).alias("poor_calls"), F.count(F.lit(1)).alias("total_calls"),
        count_if(F.col("mos").between(3.5, 4.0)).alias("acceptable"),
        count_if((F.col("mos") >= 3.0) & (F.col("mos") < 3.5)).alias("poor"),
        count_if(F.col("mos") < 3.0).alias("very_poor"))
    rate = rnd(pct(F.col("poor_calls"), F.col("total_calls")), 2)
    return g.select(*keys, "poor_calls", "total_calls", r4(rate).alias("poor_call_rate"), "acceptable", "poor",
                    "very_poor", status(rate, 3.0, 5.0, higher_is_better=False).alias("status"))


def concurrent_calls(calls: DataFrame, capacity: float, unit: str = "day", bucket: str = "hour") -> DataFrame:
    """IND-3.3: concurrent calls from starts and ends (at one instant ends come first); peak, time-weighted
    mean and utilisation of the trunk capacity per reporting period `unit`.

    Changes are summed by instant before anything is ordered, so that many calls that start together are one row.
    Exact two-level prefix sum, no global ordering: a running sum inside each `bucket`, plus a
    carry-in per bucket = the running total of the per-bucket net counts (one row per bucket). Every bucket
    has a row at its start, so calls carried into a period count in its peak and its mean.
    """
    start = F.col("call_time")
    end = start + F.make_dt_interval(secs=(F.col("duration_min") * 60).cast("decimal(18,6)"))
    c = calls.select(start.alias("s"), end.alias("e"))
    ev = c.select(F.col("s").alias("t"), F.lit(1).alias("d")).unionByName(c.select(F.col("e").alias("t"), F.lit(-1).alias("d")))
    at = ev.groupBy("t").agg(F.sum("d").alias("d"))
    ends = at.agg(F.min(F.date_trunc(bucket, "t")).alias("lo"), F.max(F.date_trunc(bucket, "t")).alias("hi"))
    marks = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {bucket}"))).alias("t"), F.lit(0).cast("long").alias("d"))
    at = at.unionByName(marks).groupBy("t").agg(F.sum("d").alias("d")).withColumn("b", F.date_trunc(bucket, "t"))
    net = at.groupBy("b").agg(F.sum("d").alias("net"))
    carry = net.withColumn("carry", F.coalesce(F.sum("net").over(
        Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("net")
    w = Window.partitionBy("b").orderBy("t")
    run = (at.withColumn("conc", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("until", F.coalesce(F.lead("t").over(w), F.col("b") + F.expr(f"INTERVAL 1 {bucket}")))
           .join(carry, "b").withColumn("concurrent", F.col("conc") + F.col("carry"))
           .withColumn("secs", (F.unix_micros("until") - F.unix_micros("t")) / 1e6))
    g = run.groupBy(F.date_trunc(unit, "t").alias("p")).agg(
        F.max("concurrent").alias("peak_concurrent"),
        (F.sum(F.col("concurrent") * F.col("secs")) / F.sum("secs")).alias("avg_concurrent"))
    return g.select(ts_text("p").alias("period"), F.col("peak_concurrent").cast("long").alias("peak_concurrent"),
                    r4("avg_concurrent").alias("avg_concurrent"),
                    r4(F.col("peak_concurrent") * 100.0 / capacity).alias("peak_utilisation_pct"),
                    status(F.col("peak_concurrent") * 100.0 / capacity, 80.0, 90.0, higher_is_better=False).alias("status"))


def queue_wait(calls: DataFrame, as_of: Column, window_s: int = 30 * DAY) -> DataFrame:
    """IND-3.4: average speed of answer Σwait / answered, per queue, as m:ss; limit 3:00."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.groupBy("queue").agg((F.sum("wait_sec") / F.count(F.lit(1))).alias("asa_sec"), F.count(F.lit(1)).alias("answered"))
    return g.select("queue", r4("asa_sec").alias("asa_sec"), mmss(F.col("asa_sec")).alias("asa_text"), "answered",
                    status(F.col("asa_sec"), 90.0, 180.0, higher_is_better=False).alias("status"))


# --------------------------------------------------------------------------- IND-9.4 (JOIN-13)
def repeat_contacts(contacts: DataFrame, as_of: Column, lookback_s: int = 7 * DAY) -> DataFrame:
    """Repeat contact: same customer and category within 7 days before (previous contact by lag,
    no self-join). Rates for the current hour, rolling 4 hours and today, by reason."""
    c = neighbour_within(contacts, ["customer_id", "category"], ["contact_time", "contact_id"], lookback_s, [], "prev", "p_")
    c = c.withColumn("is_repeat", F.col("p_contact_time").isNotNull())
    c = c.filter(F.col("contact_time") <= as_of)
    in_h = since("contact_time", as_of, HOUR)
    in_4h = since("contact_time", as_of, 4 * HOUR)
    today = F.col("contact_time") >= F.date_trunc("day", as_of)
    g = c.groupBy("category").agg(
        count_if(in_h).alias("contacts_1h"), count_if(in_h & F.col("is_repeat")).alias("repeats_1h"),
        count_if(in_4h).alias("contacts_4h"), count_if(in_4h & F.col("is_repeat")).alias("repeats_4h"),
        count_if(today).alias("contacts_today"), count_if(today & F.col("is_repeat")).alias("repeats_today"),
        F.count(F.lit(1)).alias("contacts_all"), count_if(F.col("is_repeat")).alias("repeats_all"))
    rate = pct(F.col("repeats_all"), F.col("contacts_all"))
    return g.select("category", "contacts_1h", "repeats_1h", "contacts_4h", "repeats_4h", "contacts_today",
                    "repeats_today", "contacts_all", "repeats_all",
                    r4(pct(F.col("repeats_today"), F.col("contacts_today"))).alias("repeat_rate_today"),
                    r4(rate).alias("repeat_rate_all"), status(rate, 20.0, 30.0, higher_is_better=False).alias("status"))


# --------------------------------------------------------------------------- IND-13.3
def cross_channel_journeys(contacts: DataFrame, gap_s: int = 7 * DAY, resolved_categories=("purchase", "signup")) -> DataFrame:
    """Journeys per customer: a new journey starts after a gap > 7 days (`sessionize`: bucketed, exact).
    A journey is cross-channel with >= 2 channels; resolved when its last contact is in
    `resolved_categories`. Rate = resolved cross-channel journeys / cross-channel journeys."""
    c = sessionize(contacts, ["customer_id"], ["contact_time", "contact_id"], gap_s, bucket_s=30 * DAY, out="journey")
    j = c.groupBy("customer_id", "journey").agg(
        F.countDistinct("channel").alias("channels"), F.count(F.lit(1)).alias("contacts"),
        F.max_by("category", F.struct("contact_time", "contact_id")).alias("last_category"))
    x = j.filter(F.col("channels") >= 2)
    g = x.agg(F.count(F.lit(1)).alias("cross_channel_journeys"),
              count_if(F.col("last_category").isin(*resolved_categories)).alias("resolved"))
    rate = pct(F.col("resolved"), F.col("cross_channel_journeys"))
    return g.select("cross_channel_journeys", "resolved", r4(rate).alias("resolution_rate"),
                    status(rate, 80.0, 70.0).alias("status"))


# --------------------------------------------------------------------------- IND-11.1 / IND-14.4 (transcripts)
def phrase_count(text: Column, phrases) -> Column:
    """Number of occurrences of any phrase (case-insensitive, whole words) in the whole text."""
    pat = r"(?i)\b(" + "|".join(phrases) + r")\b"
    return F.size(F.regexp_extract_all(text, F.lit(pat), 0))


# Full points of the eight parts of the quality predictor; words a minute that count as clear.
QA_POINTS = {"greeting": 15, "listening": 15, "empathy": 15, "dead_air": 10, "talk_over": 10, "clarity": 10, "hold": 10, "resolution": 15}
CLEAR_WPM = (120, 150)


def qa_predictor(transcripts: DataFrame, phrases: dict, audio: DataFrame, agent_role: str = "assistant") -> DataFrame:
    """IND-11.1: eight weighted parts per conversation, 0 to 100.

    Phrases (lists, parameters) in the agent's turns: greeting needs `company` and `agent` (half for one of them);
    `listening` and `empathy` count (listening: 3 and more full, 1 or 2: 13; empathy: 2 and more full, one: 10); `resolution` once. Audio (conv_id,
    silences, overlaps, wpm, hold_ok): 1.5 points less a silence, 2 an overlap; words a minute within CLEAR_WPM, half
    within 20 of it; the hold procedure. What wasn't measured (null, no audio row) scores nothing and is counted in `unmeasured`.
    """
    a = transcripts.filter(F.col("role") == agent_role)
    g = a.groupBy("conv_id").agg(*[F.sum(phrase_count(F.col("text"), ph)).cast("long").alias(f"n_{name}") for name, ph in phrases.items()])
    j = g.join(audio, "conv_id", "left")
    n = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0))
    full = {k: F.lit(float(v)) for k, v in QA_POINTS.items()}
    lo, hi = CLEAR_WPM
    wpm = F.col("wpm")
    pts = {
        "greeting": ladder([((n("company") > 0) & (n("agent") > 0), full["greeting"]), ((n("company") > 0) | (n("agent") > 0), full["greeting"] / 2)], 0.0),
        "listening": ladder([(n("listening") >= 3, full["listening"]), (n("listening") >= 1, 13.0)], 0.0),
        "empathy": ladder([(n("empathy") >= 2, full["empathy"]), (n("empathy") == 1, 10.0)], 0.0),
        "dead_air": F.greatest(full["dead_air"] - 1.5 * F.col("silences"), F.lit(0.0)),
        "talk_over": F.greatest(full["talk_over"] - 2.0 * F.col("overlaps"), F.lit(0.0)),
        "clarity": ladder([(wpm.isNull(), F.lit(None).cast("double")), (wpm.between(lo, hi), full["clarity"]), (wpm.between(lo - 20, hi + 20), full["clarity"] / 2)], 0.0),
        "hold": ladder([(F.col("hold_ok"), full["hold"]), (~F.col("hold_ok"), 0.0)]),
        "resolution": ladder([(n("resolution") > 0, full["resolution"])], 0.0)}
    # greatest() skips nulls: what wasn't measured has to stay null.
    pts["dead_air"], pts["talk_over"] = F.when(F.col("silences").isNotNull(), pts["dead_air"]), F.when(F.col("overlaps").isNotNull(), pts["talk_over"])
    p = j.select("conv_id", *[c.alias(f"p_{k}") for k, c in pts.items()])
    score = sum((F.coalesce(F.col(f"p_{k}"), F.lit(0.0)) for k in QA_POINTS), F.lit(0.0))
    missing = sum((F.col(f"p_{k}").isNull().cast("int") for k in QA_POINTS), F.lit(0))
    return p.select("conv_id", *[r4(f"p_{k}").alias(f"p_{k}") for k in QA_POINTS], r4(score).alias("qa_score"), missing.alias("unmeasured"),
                    ladder([(score >= 90, "Exceeds"), (score >= 80, "Meets"), (score >= 70, "Needs improvement")], "Intervention").alias("band"),
                    status(score, 85.0, 70.0).alias("status"))


def disclosure_compliance(transcripts: DataFrame, phrases, agent_role: str = "assistant") -> DataFrame:
    """IND-14.4: share of conversations whose agent turns contain a required disclosure,
    weighted by conversation volume (turn count)."""
    g = transcripts.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == agent_role, phrase_count(F.col("text"), phrases)).otherwise(0)).alias("hits"),
        F.count(F.lit(1)).alias("turns"))
    t = g.agg(F.count(F.lit(1)).alias("conversations"), count_if(F.col("hits") > 0).alias("compliant"),
              F.sum(F.when(F.col("hits") > 0, F.col("turns")).otherwise(0)).alias("compliant_turns"),
              F.sum("turns").alias("turns"))
    rate = pct(F.col("compliant_turns"), F.col("turns"))
    return t.select("conversations", "compliant", r4(pct(F.col("compliant"), F.col("conversations"))).alias("compliance_pct"),
                    r4(rate).alias("weighted_compliance_pct"), status(rate, 100.0, 99.0).alias("status"))


# --------------------------------------------------------------------------- IND-14.1 (PCI)
CARD_PATTERN = r"(\d[ -]?){12,18}\d"


def card_numbers(documents: DataFrame) -> DataFrame:
    """Card-number candidates in whole texts: 13-19 digit runs with space/dash separators, Luhn-valid."""
    cand = documents.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(CARD_PATTERN), 0)).alias("raw"))
    d = cand.withColumn("digits", F.regexp_replace("raw", "[ -]", ""))
    return d.filter(F.length("digits").between(13, 19) & luhn_ok(F.col("digits")))


PCI_CHECKS = ("dtmf", "recording", "screen", "notes", "verbal")


def pci_compliance(interactions: DataFrame, by: str = "source") -> DataFrame:
    """IND-14.1: payment interactions that pass all five checks, per `by`, with the violations of each.

    interactions: doc_id, dtmf_masked, recording_paused, screen_paused (booleans; null counts as not done), notes and
    transcript (whole texts in which no card number may stand).
    """
    hit = lambda text: interactions.select(F.col("doc_id"), F.lit("").alias("source"), F.col(text).alias("text"))
    found = {c: card_numbers(hit(t)).select("doc_id").distinct().withColumn(f"_{c}", F.lit(True)) for c, t in (("notes", "notes"), ("verbal", "transcript"))}
    j = interactions.select(by, "doc_id", "dtmf_masked", "recording_paused", "screen_paused").join(found["notes"], "doc_id", "left").join(found["verbal"], "doc_id", "left")
    bad = {"dtmf": ~F.coalesce("dtmf_masked", F.lit(False)), "recording": ~F.coalesce("recording_paused", F.lit(False)), "screen": ~F.coalesce("screen_paused", F.lit(False)),
           "notes": F.col("_notes").isNotNull(), "verbal": F.col("_verbal").isNotNull()}
    some = bad["dtmf"] | bad["recording"] | bad["screen"] | bad["notes"] | bad["verbal"]
    g = j.groupBy(by).agg(F.count(F.lit(1)).alias("interactions"), *[count_if(bad[c]).alias(f"{c}_violations") for c in PCI_CHECKS], count_if(~some).alias("compliant"))
    rate = pct(F.col("compliant"), F.col("interactions"))
    return g.select(by, "interactions", *[f"{c}_violations" for c in PCI_CHECKS], "compliant", r4(rate).alias("compliance_pct"), status(rate, 100.0, 99.5).alias("status"))


# --------------------------------------------------------------------------- IND-6.4 / IND-13.1 (channel shares)
def channel_share(contacts: DataFrame, as_of: Column, window_s: int = 30 * DAY, self_service=("view", "click")) -> DataFrame:
    """IND-6.4: self-service deflection = self-service contacts / all contacts, and the share per channel
    (group total over the window total)."""
    c = contacts.filter(since("contact_time", as_of, window_s))
    g = c.groupBy("channel").agg(F.count(F.lit(1)).alias("contacts"))
    w = Window.partitionBy()
    tot = F.sum("contacts").over(w)
    return g.select("channel", "contacts", r4(pct(F.col("contacts"), tot)).alias("share_pct"),
                    F.col("channel").isin(*self_service).alias("self_service"))


# --------------------------------------------------------------------------- IND-1.1 / IND-2.1 / IND-2.4
def availability(host_status: DataFrame, as_of: Column, window_s: int = 30 * DAY, by: str = "region") -> DataFrame:
    """Uptime / scheduled time: HEALTHY host-periods over all reported host-periods, per region and global."""
    h = host_status.filter(since("recorded_at", as_of, window_s))
    g = h.rollup(by).agg(count_if(F.col("health_status") == "HEALTHY").alias("uptime"), F.count(F.lit(1)).alias("scheduled"))
    a = pct(F.col("uptime"), F.col("scheduled"))
    return g.select(F.coalesce(F.col(by), F.lit("GLOBAL")).alias(by), "uptime", "scheduled",
                    r4(a).alias("availability_pct"), status(a, 99.9, 99.5).alias("status"))


def latency_by_agents(samples: DataFrame, as_of: Column, window_s: int, site: str = "region") -> DataFrame:
    """Latency per site weighted by the site's agents, and the exact p95 of all samples."""
    s = samples.filter(since("ts", as_of, window_s))
    per = s.groupBy(site).agg(F.avg("latency_ms").alias("lat"), F.countDistinct("agent_id").alias("agents"))
    g = per.agg((F.sum(F.col("lat") * F.col("agents")) / F.sum("agents")).alias("weighted_latency_ms"),
                F.sum("agents").alias("agents"))
    p95 = exact_percentiles(s, [], "latency_ms", [0.95], ["p95"]).scalar()
    return g.select(r4("weighted_latency_ms").alias("weighted_latency_ms"), r4(p95).alias("p95_latency_ms"),
                    F.col("agents").cast("long").alias("agents"),
                    status(F.col("weighted_latency_ms"), 120.0, 180.0, higher_is_better=False).alias("status"))


def packet_loss(traffic: DataFrame, as_of: Column, window_s: int, by: str = "region") -> DataFrame:
    """Σlost / Σsent per region and global (rollup)."""
    t = traffic.filter(since("ts", as_of, window_s))
    g = t.rollup(by).agg(F.sum("lost").alias("lost"), F.sum("sent").alias("sent"))
    v = pct(F.col("lost"), F.col("sent"))
    return g.select(F.coalesce(F.col(by), F.lit("GLOBAL")).alias(by), F.col("lost").cast("long").alias("lost"),
                    F.col("sent").cast("long").alias("sent"), r4(v).alias("packet_loss_pct"),
                    status(v, 0.5, 1.0, higher_is_better=False).alias("status"))


# --------------------------------------------------------------------------- IND-5.1 / IND-7.2 / IND-7.4 / IND-8.1 / IND-8.3
def session_success(sessions: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Strict success (fast successes) and broad success (fast + slow) over attempts."""
    s = sessions.filter(since("ts", as_of, window_s))
    g = s.agg(F.count(F.lit(1)).alias("attempts"), count_if(F.col("outcome") == "success").alias("success"),
              count_if(F.col("outcome") == "slow").alias("slow"))
    broad = pct(F.col("success") + F.col("slow"), F.col("attempts"))
    return g.select("attempts", "success", "slow", r4(pct(F.col("success"), F.col("attempts"))).alias("strict_success_pct"),
                    r4(broad).alias("success_pct"), status(broad, 98.0, 95.0).alias("status"))


def crm_response(tx: DataFrame, limits: DataFrame, as_of: Column, window_s: int, default_limit: float = 5.0) -> DataFrame:
    """Average and p95 response per transaction type against its own limit (unlisted types: the default),
    share over limit, error rate."""
    t = (tx.filter(since("ts", as_of, window_s)).join(limits, "tx_type", "left")
         .withColumn("limit_s", F.coalesce("limit_s", F.lit(default_limit))))
    g = t.groupBy("tx_type", "limit_s").agg(
        F.avg("response_s").alias("avg_s"),
        count_if(F.col("response_s") > F.col("limit_s")).alias("over_limit"), count_if(F.col("is_error")).alias("errors"),
        F.count(F.lit(1)).alias("tx"))
    g = with_percentiles(g, t, ["tx_type", "limit_s"], "response_s", {"p95_s": 0.95})
    return g.select("tx_type", "limit_s", r4("avg_s").alias("avg_s"), r4("p95_s").alias("p95_s"),
                    r4(pct(F.col("over_limit"), F.col("tx"))).alias("over_limit_pct"),
                    r4(pct(F.col("errors"), F.col("tx"))).alias("error_rate_pct"),
                    status(F.col("avg_s"), 3.0, 5.0, higher_is_better=False).alias("status"))


def api_error_rate(requests: DataFrame, as_of: Column, window_s: int, by: str = "endpoint") -> DataFrame:
    """Strict (5xx), broad (5xx + timeouts) and very broad (+ slow) error rates per endpoint."""
    r = requests.filter(since("ts", as_of, window_s))
    g = r.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), count_if(F.col("code") >= 500).alias("e5xx"),
                          count_if(F.col("timeout")).alias("timeouts"), count_if(F.col("slow")).alias("slow"))
    broad = pct(F.col("e5xx") + F.col("timeouts"), F.col("requests"))
    return g.select(by, "requests", r4(pct(F.col("e5xx"), F.col("requests"))).alias("strict_pct"), r4(broad).alias("broad_pct"),
                    r4(pct(F.col("e5xx") + F.col("timeouts") + F.col("slow"), F.col("requests"))).alias("very_broad_pct"),
                    status(broad, 0.5, 1.0, higher_is_better=False).alias("status"))


def sso_success(auth: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Authentication success rate and technical failure rate."""
    a = auth.filter(since("ts", as_of, window_s))
    g = a.agg(F.count(F.lit(1)).alias("attempts"), count_if(F.col("result") == "success").alias("success"),
              count_if(F.col("result") == "technical_failure").alias("technical_failures"))
    s = pct(F.col("success"), F.col("attempts"))
    return g.select("attempts", "success", "technical_failures", r4(s).alias("success_pct"),
                    r4(pct(F.col("technical_failures"), F.col("attempts"))).alias("technical_failure_pct"),
                    status(s, 99.5, 98.0).alias("status"))


def abnormal_terminations(ends: DataFrame, unit: str = "hour", spike_factor: float = 2.0, trail_s: int = DAY) -> DataFrame:
    """Abnormal / all session ends per period, spike when above `spike_factor` x the trailing average rate."""
    p = ends.groupBy(F.date_trunc(unit, "ts").alias("period")).agg(
        count_if(F.col("abnormal")).alias("abnormal"), F.count(F.lit(1)).alias("ends"))
    p = p.withColumn("rate", pct(F.col("abnormal"), F.col("ends")))
    w = Window.orderBy(F.col("period").cast("long")).rangeBetween(-trail_s, -1)
    p = p.withColumn("trailing", F.avg("rate").over(w))
    return p.select(ts_text("period").alias("period"), "abnormal", "ends", r4("rate").alias("abnormal_rate_pct"),
                    r4("trailing").alias("trailing_avg_pct"),
                    F.coalesce(F.col("rate") > F.col("trailing") * spike_factor, F.lit(False)).alias("spike"),
                    status(F.col("rate"), 1.0, 2.0, higher_is_better=False).alias("status"))


# --------------------------------------------------------------------------- IND-10.2 / IND-12.1
AHT_PARTS = ("talk_s", "hold_s", "acw_s")


def aht_deviation(calls: DataFrame, by: str = "queue", weeks: int = 4, sigma: float = 3.0, slot_h: int = 1) -> DataFrame:
    """AHT and its parts per `by`, day and slot of `slot_h` hours against the same slot and weekday of the previous `weeks` weeks.

    calls: `by`, call_time and talk_s, hold_s, acw_s (whole seconds). Two passes over moments that merge (n, sum, sum of squares)
    per cell: the first gives mean and SD of the single calls of the base weeks, the second leaves out calls
    beyond `sigma` SDs. A call counts for the `weeks` later cells it is a base of, so every step is a grouping
    by cell and no history is collected.
    """
    aht = sum((F.col(p) for p in AHT_PARTS), F.lit(0).cast("long"))
    c = calls.select(by, F.to_date("call_time").alias("day"), F.floor(F.hour("call_time") / slot_h).cast("int").alias("slot"),
                     *[F.col(p).cast("long").alias(p) for p in AHT_PARTS], aht.alias("aht_s"))
    cell, every = [by, "day", "slot"], ["aht_s", *AHT_PARTS]
    now = c.groupBy(*cell).agg(F.count(F.lit(1)).alias("calls"), *[F.avg(p).alias(p) for p in every])
    moments = c.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("aht_s").alias("s"), F.sum(F.col("aht_s").cast("double") * F.col("aht_s")).alias("q"))
    later = F.explode(F.sequence(F.lit(1), F.lit(weeks)))
    shift = lambda df: df.withColumn("_k", later).withColumn("day", F.date_add("day", (F.col("_k") * 7).cast("int"))).drop("_k")
    base = shift(moments).groupBy(*cell).agg(F.sum("n").alias("base_calls"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n, off = F.col("base_calls"), F.col("base_calls") * F.col("aht_s") - F.col("s")
    # |x - mean| <= sigma * SD without a division: a base of equal calls keeps them all.
    near = (n == 1) | (off.cast("double") * off * (n - 1) <= sigma * sigma * n * (n * F.col("q") - F.col("s").cast("double") * F.col("s")))
    wanted = now.select(*cell).join(base, cell)  # bases of slots that have calls
    kept = (shift(c).join(wanted, cell).filter(near).groupBy(*cell)
            .agg(F.count(F.lit(1)).alias("kept_calls"), *[F.avg(p).alias(f"base_{p}") for p in every]))
    j = now.join(base.select(*cell, "base_calls"), cell, "left").join(kept, cell, "left")
    dev = {p: F.try_divide((F.col(p) - F.col(f"base_{p}")) * 100.0, F.col(f"base_{p}")) for p in every}
    parts = [F.struct(F.coalesce(F.abs(F.col(p) - F.col(f"base_{p}")), F.lit(-1.0)).alias("d"), F.lit(-i).alias("o"), F.lit(p[:-2]).alias("part")) for i, p in enumerate(AHT_PARTS)]
    d = dev["aht_s"]
    return j.select(by, F.date_format("day", "yyyy-MM-dd").alias("day"), "slot", "calls", F.coalesce("base_calls", F.lit(0)).alias("base_calls"),
                    F.coalesce("kept_calls", F.lit(0)).alias("kept_calls"), r4("aht_s").alias("aht_s"), r4("base_aht_s").alias("baseline_aht_s"),
                    r4(d).alias("deviation_pct"), *[r4(dev[p]).alias(f"{p[:-2]}_pct") for p in AHT_PARTS],
                    F.when(d.isNotNull(), F.array_max(F.array(*parts))["part"]).alias("driver"),
                    ladder([(d.isNull(), "No Baseline"), (F.abs(d) > 10, "Critical"), (F.abs(d) > 5, "At Risk")], "Healthy").alias("status"))


def cost_per_contact(calls: DataFrame, cost_per_min: float = 0.75) -> DataFrame:
    """Cost per contact per day (handle minutes x rate / contacts) with change vs the prior day and
    the same day a week earlier (self-join on shifted days, not a global window)."""
    d = calls.groupBy(F.to_date("call_time").alias("day")).agg(
        (F.sum("duration_min") * cost_per_min / F.count(F.lit(1))).alias("cpc"), F.count(F.lit(1)).alias("contacts"))
    prev = d.select(F.col("day").alias("pday"), F.col("cpc").alias("pc"))

    def chg(df, k, name):
        j = df.join(prev, F.date_add(F.col("pday"), k) == F.col("day"), "left")
        return j.withColumn(name, r4(pct(F.col("cpc") - F.col("pc"), F.col("pc")))).drop("pday", "pc")

    out = chg(chg(d, 1, "vs_prior_pct"), 7, "vs_last_week_pct")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "contacts", r4("cpc").alias("cost_per_contact"),
                      "vs_prior_pct", "vs_last_week_pct",
                      F.when(F.abs(F.col("vs_prior_pct")) > 15, "Critical").when(F.abs(F.col("vs_prior_pct")) > 5, "At Risk")
                      .otherwise("Healthy").alias("status"))


# --------------------------------------------------------------------------- IND-13.1 / IND-13.2
def channel_containment(contacts: DataFrame, escalation_s: int = DAY) -> DataFrame:
    """A contact is contained when the same customer's next contact (lead, no self-join) is not in
    another channel within `escalation_s`. Rate per channel and the contact-weighted total."""
    c = neighbour_within(contacts, ["customer_id"], ["contact_time", "contact_id"], escalation_s, ["channel"], "next", "n_")
    c = c.withColumn("escalated", F.coalesce(F.col("n_channel") != F.col("channel"), F.lit(False)))
    g = c.groupBy("channel").agg(F.count(F.lit(1)).alias("started"), count_if(~F.col("escalated")).alias("completed"))
    rate = pct(F.col("completed"), F.col("started"))
    tot = g.agg((F.sum(F.col("started") * F.col("completed") * 100.0 / F.col("started")) / F.sum("started"))).scalar()
    return g.select("channel", "started", "completed", r4(rate).alias("containment_pct"),
                    r4(tot).alias("weighted_containment_pct"))


def channel_shift(contacts: DataFrame, as_of: Column, period_s: int, digital=("click", "view")) -> DataFrame:
    """Digital share now vs the prior period of equal length; velocity = relative change in %."""
    t = F.col("contact_time")
    cur = since(t, as_of, period_s) & (t <= as_of)
    prv = since(t, as_of, 2 * period_s) & ~since(t, as_of, period_s)
    dig = F.col("channel").isin(*digital)
    g = contacts.agg(count_if(cur).alias("contacts_now"), count_if(cur & dig).alias("digital_now"),
                     count_if(prv).alias("contacts_prior"), count_if(prv & dig).alias("digital_prior"))
    now = pct(F.col("digital_now"), F.col("contacts_now"))
    pri = pct(F.col("digital_prior"), F.col("contacts_prior"))
    vel = F.try_divide((now - pri) * 100.0, pri)
    return g.select("contacts_now", "contacts_prior", r4(now).alias("digital_share_now_pct"),
                    r4(pri).alias("digital_share_prior_pct"), r4(vel).alias("shift_velocity_pct"),
                    F.when(vel >= 1, "Healthy").when(now < pri, "Critical").otherwise("At Risk").alias("status"))


# --------------------------------------------------------------------------- weighted indices (IND-1.2, 5.3, 13.4, 14.3)
def weighted_index(df: DataFrame, weights: dict, name: str = "score") -> DataFrame:
    """Σ component x weight (weights as stated, e.g. privacy .15/.20/.15/.15/.15/.10/.10)."""
    s = None
    for c, w in weights.items():
        term = F.col(c) * F.lit(float(w))
        s = term if s is None else s + term
    return df.withColumn(name, s)


PRIVACY_WEIGHTS = {"data_minimization": 0.15, "consent": 0.20, "dsar": 0.15, "deletion": 0.15, "retention": 0.15,
                   "third_party": 0.10, "security": 0.10}


def revenue_protection(components: DataFrame) -> DataFrame:
    """IND-12.2: 100 - revenue at risk / opportunity x 100. components: (category, amount, opportunity)."""
    g = components.groupBy("opportunity").agg(F.sum("amount").alias("revenue_at_risk"))
    score = F.lit(100.0) - F.col("revenue_at_risk") * 100.0 / F.col("opportunity")
    return g.select(r4("revenue_at_risk").alias("revenue_at_risk"), r4("opportunity").alias("opportunity"),
                    r4(score).alias("protection_score"), status(score, 97.0, 95.0).alias("status"))


# --------------------------------------------------------------------------- IND-2.2 / IND-2.3 / IND-5.2
def site_connectivity(samples: DataFrame, as_of: Column, window_s: int, site: str = "region") -> DataFrame:
    """Per site: loss % and latency over the window -> Connected / Degraded / Disconnected; share connected."""
    s = samples.filter(since("ts", as_of, window_s))
    g = s.groupBy(site).agg(pct(count_if(F.col("lost")), F.count(F.lit(1))).alias("loss"), F.avg("latency_ms").alias("lat"))
    st = ladder([((F.col("loss") < 1) & (F.col("lat") < 150), "Connected"),
                 ((F.col("loss") < 5) & (F.col("lat") < 300), "Degraded")], "Disconnected")
    g = g.withColumn("site_status", st)
    share = g.agg(pct(count_if(F.col("site_status") == "Connected"), F.count(F.lit(1)))).scalar()
    return g.select(site, r4("loss").alias("loss_pct"), r4("lat").alias("latency_ms"), "site_status",
                    r4(share).alias("connected_sites_pct"))


def wan_utilisation(traffic: DataFrame, as_of: Column, capacity: float, rolling_s: int, window_s: int,
                    site: str = "region") -> DataFrame:
    """max(in, out) / capacity per site and period, rolling mean over `rolling_s` (range frame per site),
    then the average and peak over the window."""
    p = traffic.groupBy(site, F.date_trunc("hour", "ts").alias("period")).agg(F.sum("bytes_in").alias("i"),
                                                                              F.sum("bytes_out").alias("o"))
    p = p.withColumn("util", F.greatest("i", "o") * 100.0 / capacity)
    w = Window.partitionBy(site).orderBy(F.col("period").cast("long")).rangeBetween(-(rolling_s - 1), 0)
    p = p.withColumn("rolling", F.avg("util").over(w))
    cur = p.filter(since("period", as_of, window_s))
    g = cur.groupBy(site).agg(F.avg("rolling").alias("avg_util"), F.max("rolling").alias("peak_util"))
    return g.select(site, r4("avg_util").alias("avg_utilisation_pct"), r4("peak_util").alias("peak_utilisation_pct"),
                    status(F.col("peak_util"), 70.0, 85.0, higher_is_better=False).alias("status"))


def ica_latency(sessions: DataFrame, as_of: Column, window_s: int, by: str = "vendor_id") -> DataFrame:
    """Session-duration-weighted ICA latency and its exact p95, per group."""
    s = sessions.filter(since("ts", as_of, window_s))
    g = s.groupBy(by).agg((F.sum(F.col("latency_ms") * F.col("duration")) / F.sum("duration")).alias("w"))
    g = with_percentiles(g, s, [by], "latency_ms", {"p95": 0.95})
    return g.select(by, r4("w").alias("weighted_latency_ms"), r4("p95").alias("p95_latency_ms"),
                    status(F.col("w"), 60.0, 100.0, higher_is_better=False).alias("status"))


# --------------------------------------------------------------------------- IND-4.1 / 4.3 / 10.1 / 10.3 / 10.4
def staffing_gap(calls: DataFrame, interval_min: float = 1440.0, occupancy: float = 0.85, shrinkage: float = 0.30) -> DataFrame:
    """Per day: actual agents - calls x AHT / (interval x occupancy) / (1 - shrinkage)."""
    d = calls.groupBy(F.to_date("call_time").alias("day")).agg(F.countDistinct("agent_id").alias("actual"),
                                                               F.count(F.lit(1)).alias("calls"), F.avg("duration_min").alias("aht"))
    req = F.col("calls") * F.col("aht") / (interval_min * occupancy) / (1 - shrinkage)
    gap = F.col("actual") - req
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "actual", "calls", r4(req).alias("required"),
                    r4(gap).alias("gap"), ladder([(F.abs(gap) > 500, "Critical"), (F.abs(gap) > 200, "At Risk")],
                                                 "Healthy").alias("status"))


def occupancy_bands(calls: DataFrame, as_of: Column, window_s: int, shift_min: float = 480.0,
                    by: str = "vendor_id") -> DataFrame:
    """IND-4.3: handle / (handle + available) per agent-day (available = shift - handle), mean per
    group, in five bands."""
    c = calls.filter(since("call_time", as_of, window_s))
    ad = c.groupBy(by, "agent_id", F.to_date("call_time").alias("day")).agg(F.sum("duration_min").alias("handle"))
    occ = F.col("handle") * 100.0 / (F.col("handle") + F.greatest(F.lit(0.0), F.lit(shift_min) - F.col("handle")))
    g = ad.groupBy(by).agg(F.avg(occ).alias("occ"), F.count(F.lit(1)).alias("agent_days"))
    o = r4("occ")
    band = ladder([(o < 65, "Critical (idle)"), (o < 75, "At Risk (low)"), (o <= 85, "Optimal"),
                   (o <= 90, "At Risk (high)")], "Critical (burnout)")
    return g.select(by, r4("occ").alias("occupancy_pct"), "agent_days", band.alias("band"))


def occupancy_login(calls: DataFrame, as_of: Column, window_s: int, login_min: float = 480.0, aux_min: float = 60.0,
                    by: str = "queue") -> DataFrame:
    """IND-10.3: Σhandle / Σ(login - aux) per queue (agent-days)."""
    c = calls.filter(since("call_time", as_of, window_s))
    ad = c.groupBy(by, "agent_id", F.to_date("call_time").alias("day")).agg(F.sum("duration_min").alias("handle"))
    g = ad.groupBy(by).agg((F.sum("handle") * 100.0 / (F.count(F.lit(1)) * (login_min - aux_min))).alias("occ"))
    o = F.col("occ")
    return g.select(by, r4(o).alias("occupancy_pct"),
                    ladder([(o > 90, "Critical"), (o < 70, "Critical"), ((o >= 80) & (o <= 85), "Healthy")],
                           "At Risk").alias("status"))


def shrinkage(calls: DataFrame, roster: DataFrame, planned_pct: float = 30.0) -> DataFrame:
    """IND-10.1: per day, actual shrinkage = 1 - present / roster; variance to plan; FTE impact."""
    n = roster.agg(F.count(F.lit(1))).scalar()
    d = calls.groupBy(F.to_date("call_time").alias("day")).agg(F.countDistinct("agent_id").alias("present"))
    act = (F.lit(1.0) - F.col("present") / n) * 100.0
    var = act - planned_pct
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "present", r4(act).alias("actual_shrinkage_pct"),
                    r4(var).alias("variance_pct"), r4(var / 100.0 * n).alias("fte_impact"),
                    ladder([(F.abs(var) > 5, "Critical"), (F.abs(var) > 2, "At Risk")], "Healthy").alias("status"))


def schedule_efficiency(calls: DataFrame, as_of: Column, window_s: int, shift_min: float = 480.0) -> DataFrame:
    """IND-10.4: 1 - Σ|required - scheduled| / Σrequired over the intervals (days) of the window."""
    c = calls.filter(since("call_time", as_of, window_s))
    d = c.groupBy(F.to_date("call_time").alias("day")).agg(
        (F.sum("duration_min") / shift_min).alias("req"), F.countDistinct("agent_id").alias("sched"))
    g = d.agg(F.sum(F.abs(F.col("req") - F.col("sched"))).alias("dev"), F.sum("req").alias("req"),
              F.count(F.lit(1)).alias("intervals"))
    eff = (F.lit(1.0) - F.col("dev") / F.col("req")) * 100.0
    return g.select("intervals", r4("req").alias("required_total"), r4(eff).alias("efficiency_pct"),
                    status(eff, 95.0, 90.0).alias("status"))


# --------------------------------------------------------------------------- IND-11.4 / IND-7.3
def coaching_priority(calls: DataFrame, as_of: Column, window_s: int, cohort: str = "vendor_id",
                      full_coachability_calls: int = 20) -> DataFrame:
    """(best score in cohort - agent score) x coachability; priority first when above 30."""
    c = calls.filter(since("call_time", as_of, window_s))
    a = c.groupBy(cohort, "agent_id").agg((F.avg("mos") * 20.0).alias("score"), F.count(F.lit(1)).alias("calls"))
    w = Window.partitionBy(cohort)
    a = a.withColumn("best", F.max("score").over(w))
    coach = F.least(F.lit(1.0), F.col("calls") / float(full_coachability_calls))
    pr = (F.col("best") - F.col("score")) * coach
    return a.select(cohort, "agent_id", r4("score").alias("score"), r4("best").alias("cohort_best"),
                    r4(coach).alias("coachability"), r4(pr).alias("priority"), (pr > 30).alias("coach_first"))


def data_freshness(events: DataFrame, limits: DataFrame, as_of: Column, source: str = "source",
                   default_limit: int = 60) -> DataFrame:
    """Seconds since the last record per source against the source's own limit (unlisted sources: the default);
    the stalest source, which sets the overall value, is marked."""
    g = events.groupBy(source).agg(F.max("ts").alias("last_seen"))
    j = g.join(limits, source, "left").withColumn("limit_s", F.coalesce("limit_s", F.lit(default_limit)))
    stalest = g.select(F.min("last_seen")).scalar()
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("last_seen")) / 1_000_000)
    return j.select(source, ts_text("last_seen").alias("last_seen"), age.cast("long").alias("age_s"), "limit_s",
                    (F.col("last_seen") == stalest).alias("is_worst"),
                    F.when(age > F.col("limit_s"), "Critical").when(age > F.col("limit_s") * 0.85, "At Risk")
                    .otherwise("Healthy").alias("status"))


# --------------------------------------------------------------------------- IND-4.2 (interval-overlap join)
def _hour_buckets(df: DataFrame, start: str, end: str) -> DataFrame:
    first = F.floor(F.unix_micros(start) / 3_600_000_000).cast("long")
    last = F.floor((F.unix_micros(end) - 1) / 3_600_000_000).cast("long")
    return df.withColumn("bucket", F.explode(F.when(last >= first, F.sequence(first, last))))


def schedule_adherence(states: DataFrame, schedule: DataFrame) -> DataFrame:
    """Minutes in the scheduled state / scheduled minutes, per day.

    Interval-overlap join done as an equi-join on (agent, hour bucket): both sides are
    exploded into the hour buckets they cover and the overlap is clipped to the bucket,
    so each minute is counted once and no agent's intervals pair with all of its others.
    states: (agent_id, state, start_ts, end_ts); schedule: (agent_id, day, state, start_ts, end_ts).
    """
    a = _hour_buckets(states.select("agent_id", F.col("state").alias("a_state"), F.col("start_ts").alias("a_s"),
                                    F.col("end_ts").alias("a_e")), "a_s", "a_e")
    s = _hour_buckets(schedule.select("agent_id", "day", F.col("state").alias("s_state"), F.col("start_ts").alias("s_s"),
                                      F.col("end_ts").alias("s_e")), "s_s", "s_e")
    j = s.join(a, ["agent_id", "bucket"]).filter(F.col("a_state") == F.col("s_state"))
    b0 = F.timestamp_micros(F.col("bucket") * 3_600_000_000)
    b1 = F.timestamp_micros((F.col("bucket") + 1) * 3_600_000_000)
    lo = F.greatest(F.col("a_s"), F.col("s_s"), b0)
    hi = F.least(F.col("a_e"), F.col("s_e"), b1)
    ov = F.greatest(F.lit(0.0), (F.unix_micros(hi) - F.unix_micros(lo)) / 60_000_000.0)
    adh = j.groupBy("day").agg(F.sum(ov).alias("adherent_min"))
    sched = schedule.groupBy("day").agg(F.sum((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 60_000_000.0)
                                        .alias("scheduled_min"))
    out = sched.join(adh, "day", "left").fillna(0.0, ["adherent_min"])
    p = pct(F.col("adherent_min"), F.col("scheduled_min"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), r4("scheduled_min").alias("scheduled_min"),
                      r4("adherent_min").alias("adherent_min"), r4(p).alias("adherence_pct"), status(p, 92.0, 85.0).alias("status"))


# --------------------------------------------------------------------------- IND-11.3 (JOIN-14)
def readiness(agents: DataFrame, required_skills: Column, required_systems: Column) -> DataFrame:
    """Mean of skill match, system access, training currency and tool performance per agent.

    agents: (agent_id, skills array, systems array, certs_current, certs_required, tool_ms).
    Skill / system match = |have ∩ required| / |required| (array_intersect, no join)."""
    sm = F.size(F.array_intersect("skills", required_skills)) * 100.0 / F.size(required_skills)
    sa = F.size(F.array_intersect("systems", required_systems)) * 100.0 / F.size(required_systems)
    tc = F.try_divide(F.col("certs_current") * 100.0, F.col("certs_required").cast("double"))
    tp = F.lit(100.0) - F.col("tool_ms") / 50.0
    idx = (sm + sa + tc + tp) / 4
    return agents.select("agent_id", r4(sm).alias("skill_match"), r4(sa).alias("system_access"), r4(tc).alias("training"),
                         r4(tp).alias("tool_performance"), r4(idx).alias("readiness_index"),
                         ladder([(idx >= 90, "Fully ready"), (idx >= 75, "Partially ready")], "Not ready").alias("status"))


# --------------------------------------------------------------------------- IND-11.2
# Attrition risk factor points (enterprise indicator 11.2).
ATTRITION_POINTS = {"tenure_lt_90d": 20, "forced_schedule_change": 15, "declining_qa": 12, "absenteeism": 12,
                    "adherence_decline": 10, "aht_increase": 10, "complaints": 8, "no_promotion_18m": 8,
                    "low_engagement": 10, "team_attrition": 5}


def attrition_risk(factors: DataFrame) -> DataFrame:
    """Sum of the points of the factors present (boolean columns), capped at 100 (F25), four levels."""
    pts = None
    present = [c for c in ATTRITION_POINTS if c in factors.columns]
    for c in present:
        t = F.when(F.col(c), F.lit(ATTRITION_POINTS[c])).otherwise(F.lit(0))
        pts = t if pts is None else pts + t
    score = F.least(F.lit(100), pts)
    return factors.select("agent_id", *present, score.alias("risk_score"),
                          ladder([(score < 25, "Low"), (score < 50, "Medium"), (score < 75, "High")], "Critical").alias("risk_level"))


# --------------------------------------------------------------------------- IND-14.2
# The consents that allow a call, by its purpose; the hours of the called person in which it may be made.
CONSENT_FOR = {"marketing": ("written",), "informational": ("written", "verbal"), "transactional": ("ebr",), "collections": ("written", "verbal", "ebr")}
CONSENT_TYPES = ("written", "verbal", "ebr")
CALL_HOURS = (8, 21)


def call_consent(calls: DataFrame, consents: DataFrame, do_not_call: DataFrame, segment_s: float = 90 * DAY) -> DataFrame:
    """Each outbound call with `reason`: verified, or why it is blocked.

    calls: call_id, customer_id, call_type, call_time, utc_offset_h; consents: customer_id, consent_type, action (grant or
    revoke), at, event_id; do_not_call: customer_id, since. A consent holds from its grant until it is revoked: the state of each type is the
    last event at or before the call (segmented as-of join, so a customer's history may be long). Checked in this order:
    consent of a type that the purpose needs (revoked, wrong_type, no_consent), the do-not-call list, the local hour.
    """
    e = consents.select("customer_id", F.col("at").alias("call_time"), "event_id",
                        *[F.when(F.col("consent_type") == t, F.col("action")).alias(t) for t in CONSENT_TYPES])
    c = asof_last(calls, e, ["customer_id"], "call_time", ["event_id"], list(CONSENT_TYPES), segment_s)
    granted = {t: F.coalesce(F.col(t) == "grant", F.lit(False)) for t in CONSENT_TYPES}
    revoked = {t: F.coalesce(F.col(t) == "revoke", F.lit(False)) for t in CONSENT_TYPES}

    def needed(state: dict) -> Column:
        fits = F.lit(False)
        for purpose, types in CONSENT_FOR.items():
            for t in types:
                fits = fits | ((F.col("call_type") == purpose) & state[t])
        return F.coalesce(fits, F.lit(False))

    listed = do_not_call.groupBy("customer_id").agg(F.min("since").alias("_since"))
    j = c.join(listed, "customer_id", "left")
    local = F.hour(F.col("call_time") + F.make_dt_interval(hours=F.col("utc_offset_h").cast("int")))
    some = granted["written"] | granted["verbal"] | granted["ebr"]
    reason = ladder([
        (~needed(granted) & needed(revoked), "revoked"), (~needed(granted) & some, "wrong_type"), (~needed(granted), "no_consent"),
        (F.col("_since") <= F.col("call_time"), "do_not_call"), (~local.between(CALL_HOURS[0], CALL_HOURS[1] - 1), "outside_hours")], "verified")
    return j.select(*calls.columns, reason.alias("reason"))


BLOCKS = ("revoked", "wrong_type", "no_consent", "do_not_call", "outside_hours")


def consent_verification(calls: DataFrame, consents: DataFrame, do_not_call: DataFrame, segment_s: float = 90 * DAY) -> DataFrame:
    """Verified calls of all, by purpose and in total, with the blocked ones by reason."""
    g = call_consent(calls, consents, do_not_call, segment_s).rollup("call_type").agg(
        F.count(F.lit(1)).alias("outbound"), count_if(F.col("reason") == "verified").alias("verified"),
        *[count_if(F.col("reason") == b).alias(b) for b in BLOCKS], F.grouping_id().alias("_g"))
    v = pct(F.col("verified"), F.col("outbound"))
    return g.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("call_type")).alias("call_type"), "outbound", "verified", *BLOCKS,
                    r4(v).alias("verification_rate"), r4(F.lit(100.0) - v).alias("block_rate"), status(v, 100.0, 99.0).alias("status"))


# --------------------------------------------------------------------------- IND-6.1 / 6.3 / 12.4 (next-contact rules)
def _next_contact(contacts: DataFrame, window_s: int = DAY) -> DataFrame:
    """Each contact with the same customer's next contact (time, channel) if it comes within the window."""
    c = neighbour_within(contacts, ["customer_id"], ["contact_time", "contact_id"], window_s, ["channel"], "next", "n_")
    return c.withColumnRenamed("n_contact_time", "next_time").withColumnRenamed("n_channel", "next_channel")


def _within(s: int) -> Column:
    return F.col("next_time").isNotNull()


def ivr_containment(contacts: DataFrame, ivr_channel: str, window_s: int = DAY) -> DataFrame:
    """Strict: no further contact within the window; broad: no further contact in another channel."""
    c = _next_contact(contacts, window_s).filter(F.col("channel") == ivr_channel)
    g = c.agg(F.count(F.lit(1)).alias("ivr_sessions"), count_if(~_within(window_s)).alias("contained_strict"),
              count_if(~(_within(window_s) & (F.col("next_channel") != F.col("channel")))).alias("contained_broad"))
    broad = pct(F.col("contained_broad"), F.col("ivr_sessions"))
    return g.select("ivr_sessions", r4(pct(F.col("contained_strict"), F.col("ivr_sessions"))).alias("strict_pct"),
                    r4(broad).alias("broad_pct"), status(broad, 68.0, 60.0).alias("status"))


def chatbot_by_intent(contacts: DataFrame, bot_channel: str, intent: Column, window_s: int = DAY) -> DataFrame:
    """Per intent: resolved (no further contact in the window) and escalated (next contact in another channel)."""
    c = _next_contact(contacts, window_s).filter(F.col("channel") == bot_channel).withColumn("intent", intent)
    g = c.groupBy("intent").agg(F.count(F.lit(1)).alias("sessions"), count_if(~_within(window_s)).alias("resolved"),
                                count_if(_within(window_s) & (F.col("next_channel") != F.col("channel"))).alias("escalated"))
    res = pct(F.col("resolved"), F.col("sessions"))
    return g.select("intent", "sessions", r4(res).alias("resolution_pct"),
                    r4(pct(F.col("escalated"), F.col("sessions"))).alias("escalation_pct"), status(res, 65.0, 55.0).alias("status"))


def avoidable_contacts(contacts: DataFrame, cost_per_contact: float = 6.0, repeat_s: int = 7 * DAY,
                       failure_channel: str = "error") -> DataFrame:
    """Avoidable = repeat of the same category within 7 days or a failure contact; cost and rate per category."""
    c = neighbour_within(contacts, ["customer_id", "category"], ["contact_time", "contact_id"], repeat_s, [], "prev", "p_")
    c = c.withColumn("repeat", F.col("p_contact_time").isNotNull())
    av = F.col("repeat") | (F.col("channel") == failure_channel)
    g = c.groupBy("category").agg(F.count(F.lit(1)).alias("contacts"), count_if(av).alias("avoidable"))
    rate = pct(F.col("avoidable"), F.col("contacts"))
    return g.select("category", "contacts", "avoidable", r4(F.col("avoidable") * cost_per_contact).alias("avoidable_cost"),
                    r4(rate).alias("avoidable_rate_pct"), status(rate, 15.0, 25.0, higher_is_better=False).alias("status"))


# --------------------------------------------------------------------------- IND-7.1 / IND-8.2 / IND-1.3
def screen_pop(pops: DataFrame, as_of: Column, window_s: int, strict_ms: float = 100.0, broad_ms: float = 300.0) -> DataFrame:
    """Screen pops delivered within the strict / broad latency limit over all pops."""
    p = pops.filter(since("ts", as_of, window_s))
    g = p.agg(F.count(F.lit(1)).alias("pops"), count_if(F.col("pop_ms") <= strict_ms).alias("strict_ok"),
              count_if(F.col("pop_ms") <= broad_ms).alias("broad_ok"))
    broad = pct(F.col("broad_ok"), F.col("pops"))
    return g.select("pops", r4(pct(F.col("strict_ok"), F.col("pops"))).alias("strict_pct"), r4(broad).alias("broad_pct"),
                    status(broad, 99.0, 95.0).alias("status"))


def mfa_compliance(users: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Active users with MFA enrolled / active users; the rest need remediation (left anti join)."""
    missing = users.join(enrolled, "user_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    g = users.agg(F.count(F.lit(1)).alias("active_users"))
    v = pct(F.col("active_users") - missing, F.col("active_users"))
    return g.select("active_users", missing.alias("remediation_needed"), r4(v).alias("compliance_pct"),
                    status(v, 100.0, 99.0).alias("status"))


def headroom(usage: DataFrame, capacities: dict, by: str = "region") -> DataFrame:
    """Per group: 100 - peak utilisation of each component (peak period value / capacity); headroom is
    the smallest of them (the tightest component)."""
    aggs = [F.max(c).alias(c) for c in capacities]
    g = usage.groupBy(by).agg(*aggs)
    parts = {c: F.lit(100.0) - F.col(c) * 100.0 / cap for c, cap in capacities.items()}
    hr = F.least(*parts.values())
    return g.select(by, *[r4(v).alias(f"{c}_headroom") for c, v in parts.items()], r4(hr).alias("headroom_pct"),
                    status(hr, 20.0, 10.0).alias("status"))


# --------------------------------------------------------------------------- IND-9.2
# Effort penalty points of the CES predictor (enterprise indicator 9.2).
CES_PENALTIES = {"repeat_contact": 20, "long_hold": 15, "auth_failure": 10, "channel_switch": 15, "escalation": 10,
                 "long_handle": 10}


def ces_predictor(contacts: DataFrame, hold_limit: float = 120.0) -> DataFrame:
    """100 - effort penalties per contact, then per category: mean CES-P and the high-effort share.

    Previous / next contact of the customer come from lag / lead; the long-handle test uses the
    category mean from a grouped aggregate joined back (categories are few), not a window over a
    whole category."""
    day = F.make_dt_interval(days=F.lit(1))
    o = ["contact_time", "contact_id"]
    c = neighbour_within(contacts, ["customer_id"], o, DAY, ["channel"], "prev", "pv_")
    c = neighbour_within(c, ["customer_id"], o, DAY, ["channel"], "next", "nx_")
    c = neighbour_within(c, ["customer_id", "category"], o, 7 * DAY, [], "prev", "pc_")
    c = (c.withColumnRenamed("pv_contact_time", "p_t").withColumnRenamed("pv_channel", "p_ch")
         .withColumnRenamed("nx_contact_time", "n_t").withColumnRenamed("nx_channel", "n_ch")
         .withColumnRenamed("pc_contact_time", "pc_t"))
    avg = contacts.groupBy("category").agg(F.avg("value").alias("cat_avg"))
    c = c.join(avg, "category")
    f = {
        "repeat_contact": F.col("pc_t").isNotNull() & (F.col("contact_time") <= F.col("pc_t") + F.make_dt_interval(days=F.lit(7))),
        "long_hold": F.col("value") > hold_limit,
        "auth_failure": (F.col("p_ch") == "error") & (F.col("contact_time") <= F.col("p_t") + F.make_dt_interval(hours=F.lit(1))),
        "channel_switch": (F.col("p_ch") != F.col("channel")) & (F.col("contact_time") <= F.col("p_t") + day),
        "escalation": (F.col("n_ch") != F.col("channel")) & (F.col("n_t") <= F.col("contact_time") + day),
        "long_handle": F.col("value") > 2 * F.col("cat_avg"),
    }
    pen = None
    for k, cond in f.items():
        t = F.when(F.coalesce(cond, F.lit(False)), F.lit(CES_PENALTIES[k])).otherwise(F.lit(0))
        pen = t if pen is None else pen + t
    c = c.withColumn("ces_p", F.lit(100) - pen)
    g = c.groupBy("category").agg(F.avg("ces_p").alias("ces"), count_if(F.col("ces_p") < 60).alias("high_effort"),
                                  F.count(F.lit(1)).alias("contacts"))
    return g.select("category", "contacts", r4("ces").alias("ces_predictor"),
                    r4(pct(F.col("high_effort"), F.col("contacts"))).alias("high_effort_pct"),
                    ladder([(r4("ces") >= 75, "Healthy"), (r4("ces") >= 60, "At Risk")], "Critical").alias("status"))


# Weights of the weighted-sum indices (enterprise indicators 1.2, 5.3, 13.4).
DR_WEIGHTS = {"replication": 0.30, "test_recency": 0.25, "rto_confidence": 0.25, "capacity_match": 0.20}
DEX_WEIGHTS = {"device": 0.20, "os": 0.15, "app": 0.25, "network": 0.20, "sentiment": 0.20}
DXS_WEIGHTS = {"task_completion": 0.30, "response_time": 0.25, "effort": 0.25, "satisfaction": 0.20}


# --------------------------------------------------------------------------- IND-12.3 / IND-5.4
def labour_efficiency(calls: DataFrame, as_of: Column, window_s: int, paid_hours_per_day: float = 8.0,
                      by: str = "vendor_id") -> DataFrame:
    """(contacts x (0.8 + QA / 100 x 0.4)) / paid hours; QA = 20 x mean MOS, paid hours = agent-days x 8."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.groupBy(by).agg(F.count(F.lit(1)).alias("contacts"), (F.avg("mos") * 20.0).alias("qa"),
                          F.countDistinct("agent_id", F.to_date("call_time")).alias("agent_days"))
    qf = F.lit(0.8) + F.col("qa") / 100.0 * 0.4
    ler = F.col("contacts") * qf / (F.col("agent_days") * paid_hours_per_day)
    return g.select(by, "contacts", r4("qa").alias("qa_score"), r4(qf).alias("quality_factor"), r4(ler).alias("labour_efficiency"),
                    status(ler, 4.0, 3.0).alias("status"))


def vda_health(vdas: DataFrame, sessions_per_vda: int = 60, load_limit: float = 10000.0) -> DataFrame:
    """Healthy = registered, load index under the limit and no critical alert; capacity = healthy x sessions."""
    healthy = (F.col("state") == "Registered") & (F.col("load_index") < load_limit) & ~F.col("critical_alert")
    g = vdas.agg(F.count(F.lit(1)).alias("vdas"), count_if(healthy).alias("healthy"))
    v = pct(F.col("healthy"), F.col("vdas"))
    return g.select("vdas", "healthy", r4(v).alias("vda_health_pct"),
                    (F.col("healthy") * sessions_per_vda).alias("available_sessions"), status(v, 85.0, 75.0).alias("status"))


# --------------------------------------------------------------------------- IND-13.4
def response_index(seconds: Column) -> Column:
    """< 30 s -> 100, 30-60 s -> 80, above: 120 - seconds, not below 0."""
    return ladder([(seconds < 30, 100.0), (seconds <= 60, 80.0)], F.greatest(F.lit(0.0), F.lit(120.0) - seconds))


def digital_experience(contacts: DataFrame, digital=("click", "view"), failure: str = "error") -> DataFrame:
    """DXS = .30 task completion + .25 response-time index + .25 effort + .20 satisfaction.

    Task completion: digital customer-days without a failure contact; response index per digital contact
    (value = seconds); effort = mean CES-P; satisfaction = 100 - repeat-contact rate."""
    d = contacts.withColumn("day", F.to_date("contact_time"))
    cd = d.groupBy("customer_id", "day").agg(count_if(F.col("channel").isin(*digital)).alias("dig"),
                                             count_if(F.col("channel") == failure).alias("fail"))
    tc = cd.filter(F.col("dig") > 0).agg(pct(count_if(F.col("fail") == 0), F.count(F.lit(1)))).scalar()
    rt = contacts.filter(F.col("channel").isin(*digital)).agg(F.avg(response_index(F.col("value")))).scalar()
    ces = ces_predictor(contacts).agg(F.sum(F.col("ces_predictor") * F.col("contacts")) / F.sum("contacts")).scalar()
    rep = repeat_contacts(contacts, contacts.select(F.max("contact_time")).scalar()) \
        .agg(pct(F.sum("repeats_all"), F.sum("contacts_all"))).scalar()
    one = contacts.agg(F.count(F.lit(1)).alias("contacts"))
    parts = one.withColumns({"task_completion": tc, "response_time": rt, "effort": ces, "satisfaction": F.lit(100.0) - rep})
    out = weighted_index(parts, DXS_WEIGHTS, "dxs")
    return out.select("contacts", *[r4(c).alias(c) for c in DXS_WEIGHTS], r4("dxs").alias("dxs"),
                      status(r4("dxs"), 80.0, 65.0).alias("status"))


# --------------------------------------------------------------------------- IND-4.4
def unplanned_shrinkage(states: DataFrame, schedule: DataFrame, technical_state: str = "offline") -> DataFrame:
    """Unplanned absent time / scheduled time per day, by category: technical issues (the technical
    state inside the schedule) and unplanned absence (scheduled time covered by no state at all).
    Same bucketed interval join as `schedule_adherence`, without the state match."""
    a = _hour_buckets(states.select("agent_id", F.col("state").alias("a_state"), F.col("start_ts").alias("a_s"),
                                    F.col("end_ts").alias("a_e")), "a_s", "a_e")
    s = _hour_buckets(schedule.select("agent_id", "day", F.col("start_ts").alias("s_s"), F.col("end_ts").alias("s_e")),
                      "s_s", "s_e")
    j = s.join(a, ["agent_id", "bucket"])
    b0 = F.timestamp_micros(F.col("bucket") * 3_600_000_000)
    b1 = F.timestamp_micros((F.col("bucket") + 1) * 3_600_000_000)
    ov = F.greatest(F.lit(0.0), (F.unix_micros(F.least("a_e", "s_e", b1)) - F.unix_micros(F.greatest("a_s", "s_s", b0)))
                    / 60_000_000.0)
    cov = j.groupBy("day").agg(F.sum(ov).alias("covered"),
                               F.sum(F.when(F.col("a_state") == technical_state, ov).otherwise(0.0)).alias("technical"))
    sched = schedule.groupBy("day").agg(F.sum((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 60_000_000.0)
                                        .alias("scheduled"))
    d = sched.join(cov, "day", "left").fillna(0.0, ["covered", "technical"])
    absent = F.col("scheduled") - F.col("covered")
    tot = pct(F.col("technical") + absent, F.col("scheduled"))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), r4("scheduled").alias("scheduled_min"),
                    r4(pct(F.col("technical"), F.col("scheduled"))).alias("technical_pct"),
                    r4(pct(absent, F.col("scheduled"))).alias("absence_pct"), r4(tot).alias("unplanned_shrinkage_pct"),
                    status(tot, 6.0, 10.0, higher_is_better=False).alias("status"))
