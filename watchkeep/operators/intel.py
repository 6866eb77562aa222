"""Threat intelligence and other look-ups as joins.

Dimension tables are fixed lists from ``watchkeep.constants``, so they are
broadcast; feeds and indicators grow with use, so how they are joined is left
to the optimizer and its size checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchkeep import constants as C
from watchkeep.functions.text import techniques
from watchkeep.operators.filters import newest
from watchkeep.sources.tables import fixed_table


def feed(spark: SparkSession, values: list[str], column: str) -> DataFrame:
    return fixed_table(spark, [(v,) for v in values], f"{column} string")


def _spread(value: Column, low: int, width: int) -> Column:
    """Score in [low, low + width), the same for the same text."""
    return (F.conv(F.substring(F.md5(value), 1, 6), 16, 10).cast("int") % width + low).cast("int")


def newest_indicators(indicators: DataFrame, kind: str) -> DataFrame:
    """The newest indicator of each value, by time and then id.

    Times and ids combine before the shuffle in a hash aggregate; the chosen
    rows are joined afterwards.  Indicators without a time are the oldest.
    """
    own = indicators.where(F.col("ioc_type") == kind)
    latest = own.groupBy(F.col("value").alias("same_value")).agg(F.max("created_at").alias("latest"))
    chosen = (F.col("value") == F.col("same_value")) & F.col("created_at").eqNullSafe(F.col("latest"))
    rows = own.select("value", "created_at", "ioc_id", "confidence", "tags").join(latest, chosen, "left_semi")
    # Rows of one value and the same time are few.
    return rows.groupBy("value").agg(F.max_by(F.struct("ioc_id", "confidence", "tags"), "ioc_id").alias("ioc"))


def blocklist(indicators: DataFrame, limit: int | None = None) -> DataFrame:
    """Active indicators; with a limit, the newest of them."""
    active = indicators.where("active")
    return active if limit is None else newest(active, limit, "ioc_id")


def ip_reputation(ips: DataFrame, indicators: DataFrame, feed_ips: DataFrame) -> DataFrame:
    """Reputation of each distinct ``ip``: feed first, then indicator, else clean."""
    known = feed_ips.select(F.col("ip"), F.lit(True).alias("in_feed"))
    reported = newest_indicators(indicators, "ip").withColumnRenamed("value", "ip")
    joined = ips.select("ip").distinct().join(known, "ip", "left").join(reported, "ip", "left")
    in_feed, in_iocs = F.coalesce("in_feed", F.lit(False)), F.col("ioc").isNotNull()
    return joined.select(
        "ip",
        F.when(in_feed, _spread(F.col("ip"), 75, 21))
        .when(in_iocs, F.coalesce(F.col("ioc.confidence"), F.lit(50)))
        .otherwise(_spread(F.col("ip"), 5, 21)).alias("risk_score"),
        (in_feed | in_iocs).alias("is_malicious"),
        in_feed.alias("threat_feed_match"),
        in_iocs.alias("ioc_match"),
        F.when(in_feed, F.array(F.lit("threat_feed_match"), F.lit("known_malicious")))
        .when(in_iocs, F.concat(F.coalesce("ioc.tags", F.array().cast("array<string>")), F.array(F.lit("ioc_match"))))
        .otherwise(F.array(F.lit("clean"))).alias("tags"),
    )


def hash_reputation(hashes: DataFrame, feed_hashes: DataFrame) -> DataFrame:
    known = feed_hashes.select(F.col("hash"), F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull()
    return hashes.select("hash").distinct().join(known, "hash", "left").select(
        "hash", hit.alias("is_malicious"),
        F.when(hit, "malware").otherwise("unknown").alias("threat_type"),
        F.when(hit, 95).otherwise(5).cast("int").alias("risk_score"),
    )


def tactics(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, list(C.TACTICS.items()), "technique string, tactic string")


def tactic_counts(alerts: DataFrame, by_parent: bool = False) -> DataFrame:
    """Alerts per tactic; with ``by_parent`` T1059.001 falls back to T1059."""
    seen = alerts.select(F.explode("mitre_techniques").alias("technique")).groupBy("technique").agg(F.count("*").alias("n"))
    table = tactics(alerts.sparkSession)
    found = seen.join(F.broadcast(table), "technique", "left")
    if by_parent:
        parents = table.select(F.col("technique").alias("parent"), F.col("tactic").alias("parent_tactic"))
        found = (
            found.withColumn("parent", F.substring_index("technique", ".", 1))
            .join(F.broadcast(parents), "parent", "left")
            .withColumn("tactic", F.coalesce("tactic", "parent_tactic"))
        )
    return found.groupBy(F.coalesce("tactic", F.lit("Unknown")).alias("tactic")).agg(F.sum("n").alias("n"))


def with_event_meaning(logs: DataFrame) -> DataFrame:
    """Host logs with the description, severity and techniques of their event id."""
    rows = [(i, d, s, t) for i, (d, s, t) in C.HOST_EVENTS.items()]
    table = fixed_table(
        logs.sparkSession, rows, "event_id int, event_description string, event_severity string, event_techniques array<string>")
    return logs.join(F.broadcast(table), "event_id", "left")


def with_signature_meaning(logs: DataFrame) -> DataFrame:
    rows = [(n, s, t) for n, (s, t) in C.SIGNATURES.items()]
    table = fixed_table(
        logs.sparkSession, rows, "signature string, signature_severity string, signature_techniques array<string>")
    return logs.join(F.broadcast(table), "signature", "left")


def with_map_position(points: DataFrame) -> DataFrame:
    """Map position of each country; unknown countries go to ``Unknown``."""
    rows = [(n, x, y) for n, (x, y) in C.COUNTRY_POSITIONS.items()]
    table = fixed_table(points.sparkSession, rows, "country string, x int, y int")
    default = C.COUNTRY_POSITIONS["Unknown"]
    return points.join(F.broadcast(table), "country", "left").na.fill({"x": default[0], "y": default[1]})


def http_severity(status: Column, path: Column | None = None) -> Column:
    by_code = F.when(status < 400, "info").when(status < 500, "medium").when(status.isNotNull(), "high")
    return by_code if path is None else F.when(path.isin(C.SENSITIVE_PATHS), "high").otherwise(by_code)


def http_techniques(status: Column, path: Column) -> Column:
    exposed = status.isin(200, 201) & path.startswith("/admin")
    return F.when(exposed, F.array(F.lit("T1190"))).otherwise(F.array().cast("array<string>"))


def firewall_meaning(logs: DataFrame) -> DataFrame:
    """Allowed traffic gets technique T1071 and severity low."""
    allowed = F.col("action") == "ALLOW"
    return logs.withColumn(
        "flow_techniques", F.when(allowed, F.array(F.lit("T1071"))).otherwise(F.array().cast("array<string>"))
    ).withColumn("flow_severity", F.when(allowed, "low").otherwise(F.col("severity")))


def alerts_with_logs(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Each alert with the log it came from."""
    origin = logs.select("log_id", F.col("message").alias("log_message"), F.col("event_type").alias("log_event_type"),
                         F.col("risk_score").alias("log_risk_score"))
    return alerts.join(origin, "log_id")


def with_technique_list(df: DataFrame) -> DataFrame:
    return df.withColumn("mitre_techniques", techniques("mitre_csv"))
