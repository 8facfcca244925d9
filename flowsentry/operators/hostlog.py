"""Authentication logs: parsing, brute force, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry import dims
from flowsentry.functions.net import lookup, once
from flowsentry.plans.ordered import sliding_counts
from flowsentry.plans.storage import materialize


def syslog_timestamp(text: Column, year: int) -> Column:
    """"Jun  5 14:23:01" in the given year -> TIMESTAMP; NULL if it is not a time."""
    one_space = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), one_space), F.lit("yyyy MMM d HH:mm:ss"))


def parse_auth_events(lines: DataFrame, year: int, sudo_without_pid: bool = False) -> DataFrame:
    """Log lines -> events by the six ordered rules; lines no rule matches are dropped.

    ``lines`` has line_no and line.  The rule is decided once per line; then one
    extraction per field reads that rule's groups.
    """
    line = F.trim("line")
    rules = [
        (name, dims.AUTH_HEADER + (body.replace(r"sudo\[(\d+)\]:", r"sudo(?:\[(\d+)\])?:") if sudo_without_pid else body), event, severity)
        for name, body, event, severity in dims.AUTH_RULES
    ]
    rule = F.when(F.lit(False), "")
    for name, pattern, _, _ in rules:
        rule = rule.when(F.col("text").contains(dims.AUTH_MARKS[name]) & F.col("text").rlike(pattern), name)

    def group(i: int, only: list[str] | None = None) -> Column:
        out = F.when(F.lit(False), "")
        for name, pattern, _, _ in rules:
            if only is None or name in only:
                out = out.when(F.col("rule") == name, F.regexp_extract("text", pattern, i))
        return out

    matched = (
        lines.select("line_no", line.alias("text"))
        .select("line_no", "text", once(F.struct(rule.alias("rule"))))
        .where("rule is not null")
    )
    return matched.select(
        "line_no",
        syslog_timestamp(group(1), year).alias("ts"),
        lookup(F.col("rule"), {r[0]: r[2] for r in rules}).alias("event_type"),
        group(2).alias("hostname"),
        F.regexp_replace(group(4), ",$", "").alias("user"),
        group(5, ["SSH_FAILED", "SSH_SUCCESS"]).alias("source_ip"),
        group(3).try_cast("int").alias("pid"),
        group(5, ["SUDO_SUCCESS"]).alias("command"),
        F.concat(F.col("rule"), F.lit(": "), F.substring("text", 1, 120)).alias("description"),
        lookup(F.col("rule"), {r[0]: r[3] for r in rules}).alias("severity"),
        F.col("text").alias("raw_line"),
    )


def auth_brute_force(events: DataFrame, failures: int = 5, seconds: int = 60, chunks: int | None = None) -> DataFrame:
    """Failed logins that are the n-th of their address within the window become BRUTE_FORCE."""
    events = materialize(events)  # read three times below; parsing is the expensive part
    is_fail = (F.col("event_type") == "AUTH_FAIL") & F.col("source_ip").isNotNull() & F.col("ts").isNotNull()
    fails = events.where(is_fail).withColumn("ts_us", F.unix_micros("ts"))
    counted = sliding_counts(
        fails, "source_ip", "ts_us", "line_no", {"n_fails": (F.lit(True), seconds * 1_000_000)}, chunks=chunks
    ).drop("ts_us")
    over = F.col("n_fails") >= failures
    text = F.format_string(f"SSH brute force from %s: %d failures in {seconds}s", "source_ip", "n_fails")
    marked = counted.withColumns(
        {
            "event_type": F.when(over, "BRUTE_FORCE").otherwise(F.col("event_type")),
            "severity": F.when(over, "CRITICAL").otherwise(F.col("severity")),
            "description": F.when(over, text).otherwise(F.col("description")),
        }
    ).drop("n_fails")
    return marked.unionByName(events.where(~F.coalesce(is_fail, F.lit(False))))


def classify_log_lines(lines: DataFrame) -> DataFrame:
    """Upload profile: thirteen ordered case-insensitive rules, first match wins."""
    rule = F.when(F.lit(False), "")
    for pattern, event, *_ in dims.UPLOAD_RULES:
        rule = rule.when(F.col("lower").contains(dims.UPLOAD_MARKS[event]) & F.col("line").rlike(f"(?i){pattern}"), event)

    def group(position: int) -> Column:
        out = F.when(F.lit(False), "")
        for pattern, event, _, *groups in dims.UPLOAD_RULES:
            if groups[position]:
                out = out.when(F.col("type") == event, F.regexp_extract("line", f"(?i){pattern}", groups[position]))
        return out.otherwise(dims.NO_VALUE)

    lowered = lines.select("line_no", "line", once(F.struct(F.lower("line").alias("lower"))))
    found = lowered.select("line_no", "line", once(F.struct(rule.alias("type")))).where("type is not null")
    ts = F.regexp_extract("line", dims.UPLOAD_TIME, 1)
    return found.select(
        "line_no",
        "type",
        lookup(F.col("type"), {r[1]: r[2] for r in dims.UPLOAD_RULES}).alias("severity"),
        group(0).alias("user"),
        group(1).alias("ip"),
        ts.alias("ts"),
        F.regexp_extract(ts, dims.UPLOAD_MINUTE, 1).alias("minute"),
        F.substring(F.trim("line"), 1, 100).alias("raw"),
    )


def log_summary(events: DataFrame) -> DataFrame:
    """All counters of an uploaded log as (section, key, n) rows.

    Sections: events per type; failures per address and per user; distinct users per
    successful address; sudo runs per user.
    """
    kind, n, one = F.col("type"), F.col("n"), F.lit(1).cast("bigint")
    base = events.groupBy("type", "user", "ip").agg(F.count("*").alias("n"))

    def row(section: str, key: Column, amount: Column, only: str | None = None) -> Column:
        made = F.struct(F.lit(section).alias("section"), key.alias("key"), amount.alias("w"))
        return made if only is None else F.when(kind == only, made)

    # Each (type, user, ip) feeds up to three counters; users per address are distinct here already.
    rows = base.select(
        F.inline(
            F.array(
                row("events", kind, n),
                row("fails_by_ip", F.col("ip"), n, "SSH_FAIL"),
                row("fails_by_user", F.col("user"), n, "SSH_FAIL"),
                row("users_by_ip", F.col("ip"), one, "SSH_SUCCESS"),
                row("sudo_by_user", F.col("user"), n, "SUDO_EXEC"),
            )
        )
    )
    return rows.where("section is not null").groupBy("section", "key").agg(F.sum("w").alias("n"))


def log_kpis(events: DataFrame, threshold: int = 5) -> DataFrame:
    """One row: events, brute-force addresses, attacker addresses, targeted users, sudo runs."""
    s, n = F.col("section"), F.col("n")
    return log_summary(events).agg(
        F.coalesce(F.sum(F.when(s == "events", n)), F.lit(0)).alias("events"),
        F.count_if((s == "fails_by_ip") & (n >= threshold)).alias("brute_force_ips"),
        F.count_if(s == "fails_by_ip").alias("attacker_ips"),
        F.count_if(s == "fails_by_user").alias("targeted_users"),
        F.coalesce(F.sum(F.when(s == "sudo_by_user", n)), F.lit(0)).alias("sudo_runs"),
    )


def log_timeline(events: DataFrame) -> DataFrame:
    """Events per HH:MM (days merged), lines without a time left out."""
    return events.where("minute <> ''").groupBy("minute").agg(F.count("*").alias("events"))


def brute_force_profiles(events: DataFrame, threshold: int = 5, k: int = 10) -> DataFrame:
    """Addresses with at least ``threshold`` failures, worst ``k`` first."""
    n = F.col("failures")
    fails = events.where("type = 'SSH_FAIL'").groupBy("ip").agg(F.count("*").alias("failures"))
    return (
        fails.where(n >= threshold)
        .orderBy(n.desc(), "ip")
        .limit(k)
        .select(
            "ip",
            "failures",
            F.when(n > 50, "CRITICAL").when(n > 20, "HIGH").otherwise("MEDIUM").alias("severity"),
            F.lit("SSH Brute Force").alias("attack_type"),
            F.lit("T1110.001").alias("mitre_technique"),
            F.lit("Credential Access").alias("mitre_tactic"),
        )
    )


def top_targeted_users(events: DataFrame, k: int = 12) -> DataFrame:
    fails = events.where("type = 'SSH_FAIL'").groupBy("user").agg(F.count("*").alias("failures"))
    return fails.orderBy(F.col("failures").desc(), "user").limit(k)
