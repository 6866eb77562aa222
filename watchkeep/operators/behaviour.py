"""Behaviour profiles per user, and the risk figures built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchkeep import constants as C
from watchkeep.session import materialise

SHARES = 32  # parts a user's events are split into before they are ranked

# Rounding: a mean of integers to two decimals, half up, in integer arithmetic.
HUNDREDTHS = "cast(floor((200 * {s} + {n}) / (2 * {n})) as double) / 100"


def _mean2(total: str, count: str) -> Column:
    return F.expr(HUNDREDTHS.format(s=total, n=count))


def active(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("username") != "")


def _hour() -> Column:
    return F.date_trunc("hour", "created_at").alias("hour")


def _risk() -> Column:
    return F.coalesce("risk_score", F.lit(C.DEFAULT_RISK))


def hourly_counts(logs: DataFrame) -> DataFrame:
    """Events per user and hour."""
    return active(logs).groupBy("username", _hour()).agg(F.count("*").alias("events"), F.min("created_at").alias("first_seen"))


def hour_figures(logs: DataFrame) -> DataFrame:
    """Events, risk sum and peak risk per user and hour: all that profiles need, from one scan."""
    return active(logs).groupBy("username", _hour()).agg(
        F.count("*").alias("events"), F.min("created_at").alias("first_seen"),
        F.sum(_risk()).alias("risk_sum"), F.max(_risk()).alias("peak_risk"))


def recent_risk(logs: DataFrame, keep: int = C.RISK_HISTORY, hourly: DataFrame | None = None) -> DataFrame:
    """Sum, number and peak of the newest ``keep`` risk scores per user.

    Hours that lie wholly among the newest ``keep`` events count by their
    figures.  Only in the hour that the limit cuts are events looked at one by
    one; it is split into shares, each cut to its newest ``keep`` rows, so that
    a user with very many events in an hour is many tasks' work.  Without such
    an hour the logs are not read again.  ``hourly`` are stored ``hour_figures``.
    """
    hourly = materialise(hour_figures(logs)) if hourly is None else hourly
    before = Window.partitionBy("username").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    placed = hourly.withColumn("newer", F.coalesce(F.sum("events").over(before), F.lit(0)))
    parts = placed.where(F.col("newer") + F.col("events") <= keep).select("username", "risk_sum", F.col("events").alias("risk_n"), "peak_risk")
    cut = materialise(placed.where((F.col("newer") < keep) & (F.col("newer") + F.col("events") > keep)).select(
        "username", "hour", (F.lit(keep) - F.col("newer")).alias("need")))
    if cut.head(1):
        parts = parts.unionByName(_cut_hours(logs, cut, keep))
    return parts.groupBy("username").agg(
        F.sum("risk_sum").alias("risk_sum"), F.sum("risk_n").alias("risk_n"), F.max("peak_risk").alias("peak_risk"))


def _cut_hours(logs: DataFrame, cut: DataFrame, keep: int) -> DataFrame:
    """Figures of the newest ``need`` events of one hour per user."""
    latest = [F.desc("created_at"), F.desc("log_id")]
    in_share = F.row_number().over(Window.partitionBy("username", "share").orderBy(*latest))
    in_all = F.row_number().over(Window.partitionBy("username").orderBy(*latest))
    at = cut.select(F.col("username").alias("of"), F.col("hour").alias("at"), "need")
    return (
        active(logs)
        .select("username", "created_at", "log_id", _hour(), _risk().alias("risk"), F.pmod(F.xxhash64("log_id"), F.lit(SHARES)).alias("share"))
        .join(at, (F.col("username") == F.col("of")) & F.col("hour").eqNullSafe(F.col("at")))
        .withColumn("place", in_share).where(F.col("place") <= keep)
        .withColumn("place", in_all).where((F.col("place") <= keep) & (F.col("place") <= F.col("need")))
        .groupBy("username")
        .agg(F.sum("risk").alias("risk_sum"), F.count("*").alias("risk_n"), F.max("risk").alias("peak_risk"))
    )


def profiles(logs: DataFrame, as_of: Column) -> DataFrame:
    """All user profiles; the current hour is the one that contains ``as_of``."""
    current = F.date_trunc("hour", as_of)
    hourly = materialise(hour_figures(logs))
    hours = hourly.groupBy("username").agg(
        F.sum("events").alias("total_events"),
        F.count("*").alias("active_hours"),
        F.coalesce(F.sum(F.when(F.col("hour") == current, F.col("events"))), F.lit(0)).alias("current_hour_events"),
        F.min("first_seen").alias("first_seen"),
    )
    high = F.expr(f"risk_sum > {C.RISK_FLAG} * risk_n")
    surge = F.expr(f"current_hour_events * active_hours > {C.SURGE_FACTOR} * total_events")
    return hours.join(recent_risk(logs, hourly=hourly), "username").select(
        "username",
        _mean2("total_events", "active_hours").alias("avg_hourly_events"),
        "current_hour_events",
        _mean2("risk_sum", "risk_n").alias("avg_risk_score"),
        F.col("peak_risk").cast("int").alias("peak_risk"),
        "total_events",
        (high | surge).alias("anomaly_flag"),
        "first_seen",
    )


def profiles_of(users: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """Profiles of the given users; one never seen gets the neutral profile."""
    seen = profiles(logs.join(users.select("username").distinct(), "username", "left_semi"), as_of)
    return users.select("username").distinct().join(seen, "username", "left").select(
        "username",
        F.coalesce("avg_hourly_events", F.lit(0.0)).alias("avg_hourly_events"),
        F.coalesce("current_hour_events", F.lit(0)).cast("bigint").alias("current_hour_events"),
        F.coalesce("avg_risk_score", F.lit(float(C.DEFAULT_RISK))).alias("avg_risk_score"),
        F.coalesce("peak_risk", F.lit(0)).alias("peak_risk"),
        F.coalesce("total_events", F.lit(0)).cast("bigint").alias("total_events"),
        F.coalesce("anomaly_flag", F.lit(False)).alias("anomaly_flag"),
    )


def top_risky(all_profiles: DataFrame, limit: int = 10) -> DataFrame:
    """Highest mean risk first; ties go to the user seen earliest."""
    return all_profiles.orderBy(F.desc("avg_risk_score"), F.asc("first_seen"), F.asc("username")).limit(limit)


def population(some_profiles: DataFrame) -> DataFrame:
    return some_profiles.agg(
        F.count("*").alias("users"),
        F.count_if("anomaly_flag").alias("anomalous"),
        F.coalesce(F.floor(F.avg("avg_risk_score") + 0.5), F.lit(0)).cast("bigint").alias("avg_risk"),
    )


def radar(some_profiles: DataFrame) -> DataFrame:
    """Five features per user on a scale to 100, as (username, subject, a)."""
    hundred = F.lit(100.0)
    features = {
        "Login Freq": F.least(hundred, F.col("current_hour_events") * 5.0),
        "Risk Score": F.col("avg_risk_score"),
        "Peak Risk": F.col("peak_risk").cast("double"),
        "Hourly Vol": F.least(hundred, F.col("avg_hourly_events") * 3.0),
        "Anomaly": F.when(F.col("anomaly_flag"), 80.0).otherwise(20.0),
    }
    wide = some_profiles.select("username", *[c.alias(n) for n, c in features.items()])
    return wide.unpivot(["username"], list(features), "subject", "a")


def risk_band(score: Column, bounds: list[tuple[int, str]] | None = None, below: str = "info") -> Column:
    """Name of the band a score falls in; bounds from high to low."""
    chain = None
    for low, name in bounds or C.RISK_BANDS:
        chain = F.when(score >= low, name) if chain is None else chain.when(score >= low, name)
    return chain.otherwise(below)


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; others come last."""
    position = F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), severity)
    return F.when(position > 0, position - 1).otherwise(len(C.SEVERITIES)).cast("int")


PROFILE = ["avg_hourly_events", "current_hour_events", "avg_risk_score", "peak_risk", "total_events", "anomaly_flag"]


def entity_risk(entities: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """Risk of (entity, type): users by their profile, which comes along, anything else 50."""
    users = entities.where("type = 'user'").select(F.col("entity").alias("username"))
    known = profiles_of(users, logs, as_of).select(
        F.col("username").alias("entity"), F.lit("user").alias("type"), *PROFILE)
    is_user = F.col("type") == "user"
    return entities.join(known, ["entity", "type"], "left").select(
        "entity", "type",
        F.when(is_user, F.least(F.lit(100), F.floor("avg_risk_score"))).otherwise(50).cast("int").alias("risk_score"),
        *PROFILE,
    )
