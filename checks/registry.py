"""Every operator as a query over the given tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import derived as D
from watchkeep import constants as C
from watchkeep.functions import text as T
from watchkeep.operators import behaviour, cases, documents, filters, forest, intel, metrics, pages, updates
from watchkeep.operators.keyword_index import KeywordIndex
from watchkeep.plans import detection, rules
from watchkeep.schemas import EVENTS_INPUT
from watchkeep.session import checkpoint_folder, tune
from watchkeep.sources import tables
from watchkeep.streaming.ingest import Ingest, read_stream
from watchkeep.streaming.publish import envelope, opened, to_notify, unread
from watchkeep.streaming.rates import LiveBuffer, events_per_hour, events_per_second, to_files
from watchkeep.streaming.unread import unread_counts, unread_now

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Feed entries that occur in the given tables, next to the fixed feed.
TEST_FEED_IPS = ["203.0.113.0", "203.0.113.7", "198.51.100.1"]
TEST_FEED_HASHES = [hashlib.md5(f"Supplier#{i:09d}".encode()).hexdigest() for i in (4, 8)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: flat(fn(tune(spark), folder))
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Scalar columns only: times as microseconds, lists as text."""
    shown = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "timestamp":
            column = F.unix_micros(column)
        elif kind.startswith("array"):
            column = F.concat_ws(",", column)
        shown.append(column.alias(name))
    return df.select(*shown)


def logs(spark, folder, name="logs"):
    return intel.with_technique_list(D.derived(spark, folder, name)).drop("mitre_csv")


def alerts(spark, folder, texts=True):
    """Alerts of all rules; every third log's are acknowledged."""
    found = detection.all_alerts(D.derived(spark, folder, "burst"), texts=texts)
    return found.withColumn("acknowledged", F.col("log_id") % 3 == 0)


def indicators(spark, folder):
    found = D.derived(spark, folder, "indicators")
    return found.withColumn("tags", F.array("threat_type")).withColumn("created_at", F.timestamp_seconds((F.col("ioc_id").cast("long") * 7919) % 100003))


def incidents(spark, folder):
    return intel.with_technique_list(D.derived(spark, folder, "incidents")).drop("mitre_csv")


def requests(spark, folder):
    return intel.with_technique_list(D.derived(spark, folder, "requests")).withColumn("tags", F.array(F.lit("manual")))


def alert_commands(spark, folder):
    named = D.derived(spark, folder, "alert_commands")
    return named.withColumn("alert_id", T.stable_id(F.col("log_id").cast("string"), F.col("rule_name")))


def as_of(df):
    return metrics.latest_time(df)


# Sources and sinks


@query
def read_logs(spark, folder):
    return logs(spark, folder)


@query
def backfill_alerts(spark, folder):
    """A bulk load through the same detection as live events, per rule and severity."""
    found = detection.all_alerts(D.derived(spark, folder, "burst"), texts=False)
    return found.groupBy("rule_name", "severity").agg(F.count("*").alias("n"))


@query
def user_rule_alerts(spark, folder):
    """Default rules and one of the user's, whose test fails on most logs: there it is skipped, the others go on."""
    mine = rules.Rule(
        name="high_number", severity="low", techniques=["T1082"], tags=["user"], when=F.col("hostname").substr(6, 9).cast("int") >= 8,
        title=F.concat(F.lit("Host number "), F.col("hostname").substr(6, 9).cast("int")), description=F.lit("eight or more"))
    found = detection.all_alerts(D.derived(spark, folder, "burst"), [*rules.default_rules(), mine])
    return found.groupBy("rule_name", "severity").agg(F.count("*").alias("n"), F.count("title").alias("titles"))


@query
def export_logs(spark, folder):
    return tables.log_export(D.derived(spark, folder, "logs"))


@query
def export_alerts(spark, folder):
    return tables.alert_export(alerts(spark, folder))


@query
def export_incidents(spark, folder):
    return tables.incident_export(incidents(spark, folder))


# Filters and projections


@query
def logs_equality_filter(spark, folder):
    return logs(spark, folder).where(filters.equals_given(severity="high", hostname="", log_source="windows_event"))


@query
def filter_language(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    condition = {
        "o_orderstatus": ["F", "O"],
        "o_totalprice": {"$gte": 1000.5, "$lte": 400000.0, "$near": 3},
        "o_custkey": {"$gt": 10},
        "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", "3-MEDIUM", None], "$ne": "2-HIGH"},
        "o_comment": {"$ne": "x"},
    }
    return filters.find(orders, condition)


@query
def logs_keyword(spark, folder):
    return logs(spark, folder).where(filters.keyword("POWERSHELL"))


def _place(spark):
    """A new folder next to the checkpoints, reachable by all executors."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


@query
def logs_keyword_indexed(spark, folder):
    index = KeywordIndex(spark, _place(spark))
    index.append(logs(spark, folder))
    return index.search("POWERSHELL")


# JSON lines of events whose fields have other types from row to row; every fifth line is broken.
EVENT_LINE = """case event_id % 5 when 0 then concat('{"id": ', id, ', "kind": "', event_type, '", "level": ', k, '}')
  when 1 then concat('{"id": ', id, ', "kind": "', event_type, '", "level": "', k, '"}')
  when 2 then concat('{"id": ', id, ', "kind": ["', event_type, '"], "level": ', k, '.5}')
  when 3 then concat('{"id": ', id, ', "level": null, "kind": "', event_type, '", "tag": {"user": ', user_id, '}}')
  else concat('{"id": ', id, ', "kind": "', event_type) end as value"""


def event_lines(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.selectExpr("*", "cast(event_id as string) as id", "get_json_object(props, '$.k') as k").selectExpr(EVENT_LINE)


@query
def variant_filter(spark, folder):
    """Documents without a schema: numbers compare with numbers only, a missing tag is not equal to one."""
    found = documents.find(
        documents.documents(event_lines(spark, folder)), {"level": {"$gte": 40}, "kind": {"$ne": "view"}, "tag": None})
    return found.select(documents.field("id", "bigint").alias("id"), documents.shown("level").alias("level"), documents.shown("kind").alias("kind"))


@query
def corrupt_lines(spark, folder):
    return documents.corrupt(event_lines(spark, folder))


@query
def log_search_page(spark, folder):
    return filters.search_logs(logs(spark, folder), word="host-1", skip=20, limit=100, log_source="windows_event")


@query
def log_search_all(spark, folder):
    return filters.search_logs(
        logs(spark, folder), word="host-1", skip=20, limit=100, scope="all", log_source="windows_event")


@query
def live_feed_filter(spark, folder):
    return filters.live_feed(logs(spark, folder), severity="high", word="Web")


@query
def alerts_list(spark, folder):
    chosen = filters.find(alerts(spark, folder), {"severity": "critical", "acknowledged": False, "rule_name": "malware_indicators"})
    return filters.counted_page(chosen, "alert_id", skip=10, limit=50)


@query
def incidents_list(spark, folder):
    chosen = filters.find(incidents(spark, folder), {"status": "open", "severity": "high", "assigned_to": "analyst1"})
    return filters.counted_page(chosen, "incident_id", skip=5, limit=50)


@query
def iocs_list(spark, folder):
    chosen = filters.find(indicators(spark, folder), {"ioc_type": "ip"})
    return filters.counted_page(chosen, "ioc_id", skip=3, limit=50)


@query
def find_newest(spark, folder):
    return filters.newest_match(logs(spark, folder), {"username": "user7", "severity": {"$ne": "info"}})


@query
def newest_per_user(spark, folder):
    return filters.newest_per_key(logs(spark, folder).where("username is not null"), "username")


@query
def blocklist(spark, folder):
    return intel.blocklist(indicators(spark, folder))


@query
def blocklist_recent(spark, folder):
    """The newest 500 active indicators."""
    return intel.blocklist(indicators(spark, folder), 500)


@query
def geo_attacks(spark, folder):
    return filters.geo_events(D.derived(spark, folder, "logs"))


@query
def log_detail(spark, folder):
    shown = logs(spark, folder).select(
        "log_id", "created_at", "severity", "username", "dest_port", "message", "mitre_techniques", "country", "risk_score")
    return filters.detail_rows(shown.withColumn("created_at", F.date_format("created_at", tables.TIME_FORMAT)), "log_id")


@query
def page_past_the_end(spark, folder):
    """No row is left, the total is still given."""
    chosen = filters.find(incidents(spark, folder), {"status": "open"})
    return filters.counted_page(chosen, "incident_id", skip=10_000_000, limit=50).select("incident_id", "total")


@query
def export_all_logs(spark, folder):
    return tables.log_export(D.derived(spark, folder, "logs"), limit=None)


@query
def creation_timeline(spark, folder):
    return updates.creation_timeline(updates.create_incidents(requests(spark, folder)))


@query
def log_sources(spark, folder):
    return metrics.known_sources(D.derived(spark, folder, "logs"))


# Sorting


@query
def sorted_page(spark, folder):
    return filters.sorted_page(logs(spark, folder), "risk_score", "log_id", descending=False, skip=30, limit=70)


@query
def deep_page(spark, folder):
    """A page two thirds down the log, found without sorting what comes before."""
    found = logs(spark, folder)
    total = found.count()
    return pages.deep_page(found, ["created_at", "log_id"], skip=total * 2 // 3, limit=100, total=total, few=1000)


@query
def live_logs(spark, folder):
    return filters.newest(logs(spark, folder), 50)


@query
def recent_alerts(spark, folder):
    return filters.newest(alerts(spark, folder), 20, "alert_id")


@query
def live_buffer(spark, folder):
    newest_logs = filters.newest(D.derived(spark, folder, "logs"), 500).select(
        F.lit("log").alias("kind"), F.col("log_id").cast("string").alias("id"), "created_at")
    newest_alerts = filters.newest(alerts(spark, folder), 100, "alert_id").select(
        F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), "created_at")
    return newest_logs.unionByName(newest_alerts)


# Joins and look-ups


@query
def ip_reputation(spark, folder):
    ips = D.derived(spark, folder, "logs").select(F.col("source_ip").alias("ip"))
    return intel.ip_reputation(ips, indicators(spark, folder), intel.feed(spark, C.FEED_IPS + TEST_FEED_IPS, "ip"))


@query
def hash_reputation(spark, folder):
    hashes = indicators(spark, folder).where("ioc_type = 'hash'").select(F.col("value").alias("hash"))
    return intel.hash_reputation(hashes, intel.feed(spark, C.FEED_HASHES + TEST_FEED_HASHES, "hash"))


@query
def alert_incident_link(spark, folder):
    found = alerts(spark, folder)
    escalated = updates.escalate(found, alert_commands(spark, folder).where("cmd = 'escalate'"))
    return updates.alert_incidents(found, escalated)


@query
def alerts_with_logs(spark, folder):
    return intel.alerts_with_logs(
        alerts(spark, folder).select("alert_id", "log_id", "rule_name", "title"), D.derived(spark, folder, "burst"))


@query
def tactic_counts(spark, folder):
    return intel.tactic_counts(alerts(spark, folder, texts=False))


@query
def tactic_counts_by_parent(spark, folder):
    return intel.tactic_counts(alerts(spark, folder, texts=False), by_parent=True)


@query
def enrich_event_id(spark, folder):
    return intel.with_event_meaning(D.derived(spark, folder, "logs").select("log_id", "event_id"))


@query
def enrich_signature(spark, folder):
    return intel.with_signature_meaning(D.derived(spark, folder, "logs").select("log_id", "signature"))


@query
def geo_positions(spark, folder):
    return intel.with_map_position(filters.geo_events(D.derived(spark, folder, "logs"), None).select("log_id", "country"))


@query
def enrich_http_severity(spark, folder):
    web = D.derived(spark, folder, "web")
    return web.select("log_id", "status_code", "url_path",
                      intel.http_severity(F.col("status_code"), F.col("url_path")).alias("http_severity"))


@query
def enrich_http_mitre(spark, folder):
    web = D.derived(spark, folder, "web")
    return web.select("log_id", "status_code", "url_path",
                      intel.http_techniques(F.col("status_code"), F.col("url_path")).alias("http_techniques"))


@query
def enrich_firewall(spark, folder):
    fire = D.derived(spark, folder, "logs").where("log_source = 'firewall'")
    return intel.firewall_meaning(fire.select("log_id", "action", "severity"))


# Aggregates


@query
def count_matching(spark, folder):
    return metrics.count_matching(D.derived(spark, folder, "logs"), {"severity": ["high", "critical"], "risk_score": {"$gte": 50}})


@query
def severity_counts(spark, folder):
    return metrics.severity_counts(D.derived(spark, folder, "logs"))


@query
def log_stats(spark, folder):
    return metrics.log_stats(D.derived(spark, folder, "logs"))


@query
def log_stats_recent(spark, folder):
    """Sources and event types over the newest 10,000 logs, as the live page shows."""
    return metrics.log_stats(D.derived(spark, folder, "logs"), cap=10000)


@query
def top_attackers(spark, folder):
    return metrics.top_values(D.derived(spark, folder, "logs"), "source_ip")


@query
def top_attackers_recent(spark, folder):
    """Over the newest 5,000 logs, as the live page shows."""
    return metrics.top_values(D.derived(spark, folder, "logs"), "source_ip", cap=5000)


@query
def top_targets(spark, folder):
    return metrics.top_values(D.derived(spark, folder, "logs"), "hostname")


@query
def top_targets_recent(spark, folder):
    return metrics.top_values(D.derived(spark, folder, "logs"), "hostname", cap=5000)


@query
def mitre_coverage(spark, folder):
    return metrics.technique_coverage(alerts(spark, folder, texts=False))


@query
def mitre_coverage_recent(spark, folder):
    """Over the newest 1,000 alerts, as the live page shows."""
    return metrics.technique_coverage(alerts(spark, folder, texts=False), cap=1000)


@query
def dashboard_stats(spark, folder):
    return metrics.dashboard_stats(D.derived(spark, folder, "logs"), alerts(spark, folder, texts=False), incidents(spark, folder))


@query
def alert_summary(spark, folder):
    return metrics.alert_summary(alerts(spark, folder, texts=False))


@query
def incident_stats(spark, folder):
    return metrics.incident_stats(incidents(spark, folder))


@query
def report_summary(spark, folder):
    return metrics.report_summary(D.derived(spark, folder, "logs"), alerts(spark, folder, texts=False), incidents(spark, folder))


@query
def severity_share(spark, folder):
    return metrics.severity_share(alerts(spark, folder, texts=False))


@query
def geo_summary(spark, folder):
    return metrics.geo_summary(filters.geo_events(D.derived(spark, folder, "logs"), None))


@query
def country_counts(spark, folder):
    return metrics.country_counts(filters.geo_events(D.derived(spark, folder, "logs"), None))


@query
def relative_bars(spark, folder):
    return metrics.relative_bars(metrics.top_values(D.derived(spark, folder, "logs"), "source_ip"))


@query
def eps_history(spark, folder):
    burst = D.derived(spark, folder, "burst")
    return metrics.per_second(burst, as_of(burst))


@query
def severity_timeline(spark, folder):
    found = D.derived(spark, folder, "logs")
    return metrics.severity_timeline(found, as_of(found))


# Detection


def _rule_query(name):
    def run(spark, folder):
        rule = next(r for r in rules.default_rules() if r.name == name)
        view = "burst" if rule.threshold else "logs"
        found = detection.all_alerts(D.derived(spark, folder, view), [rule])
        return found.select("log_id", "created_at", "rule_name", "severity", "title", "description", "mitre_techniques", "tags")

    return run


for _key, _name in {
    "rule_brute_force": "brute_force", "rule_port_scan": "port_scan",
    "rule_privilege_escalation": "privilege_escalation", "rule_powershell": "suspicious_powershell",
    "rule_impossible_travel": "impossible_travel", "rule_exfiltration": "data_exfiltration",
    "rule_malware": "malware_indicators", "rule_beaconing": "beaconing",
}.items():
    _run = _rule_query(_name)
    _run.__name__ = _key
    query(_run)


@query
def all_alerts(spark, folder):
    found = detection.all_alerts(D.derived(spark, folder, "burst"))
    return found.select("alert_id", "log_id", "rule_name", "severity", "title", "description")


@query
def alert_records(spark, folder):
    return detection.all_alerts(D.derived(spark, folder, "burst"))


# Behaviour


@query
def ueba_hourly(spark, folder):
    return behaviour.hourly_counts(D.derived(spark, folder, "logs")).drop("first_seen")


@query
def ueba_profile(spark, folder):
    found = D.derived(spark, folder, "logs")
    users = spark.read.parquet(f"{folder}/events.parquet").select(
        F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string")).alias("username"))
    return behaviour.profiles_of(users, found, as_of(found))


@query
def ueba_profiles(spark, folder):
    found = D.derived(spark, folder, "logs")
    return behaviour.profiles(found, as_of(found)).drop("first_seen")


@query
def ueba_top_users(spark, folder):
    found = D.derived(spark, folder, "logs")
    return behaviour.top_risky(behaviour.profiles(found, as_of(found))).drop("first_seen")


@query
def ueba_population(spark, folder):
    found = D.derived(spark, folder, "logs")
    return behaviour.population(behaviour.profiles(found, as_of(found)))


@query
def ueba_population_top(spark, folder):
    """Figures of the ten riskiest users."""
    found = D.derived(spark, folder, "logs")
    return behaviour.population(behaviour.top_risky(behaviour.profiles(found, as_of(found))))


@query
def ueba_radar(spark, folder):
    found = D.derived(spark, folder, "logs")
    return behaviour.radar(behaviour.profiles(found, as_of(found)))


@query
def entity_risk(spark, folder):
    found = D.derived(spark, folder, "logs")
    users = found.where("username is not null").select(F.col("username").alias("entity"), F.lit("user").alias("type"))
    hosts = found.select(F.col("hostname").alias("entity"), F.lit("host").alias("type"))
    return behaviour.entity_risk(users.unionByName(hosts).distinct(), found, as_of(found))


@query
def risk_bands(spark, folder):
    score = F.col("risk_score")
    return D.derived(spark, folder, "logs").groupBy(
        behaviour.risk_band(score).alias("risk_band"),
        behaviour.risk_band(score, C.INDICATOR_BANDS, "clean").alias("indicator_band"),
    ).agg(F.count("*").alias("n"))


@query
def iforest_train(spark, folder):
    """Trees grown on samples of the logs: one row per tree."""
    nodes = forest.grow_trees(forest.samples(D.derived(spark, folder, "logs"), "log_id"))
    return nodes.groupBy("tree").agg(F.count("*").alias("nodes"), F.round(F.max("path"), 6).alias("longest_path"))


def _scored(spark, folder):
    found = D.derived(spark, folder, "logs")
    return forest.flag(forest.score(found, forest.fit(found, "log_id"))).select(
        "log_id", "risk_score", "anomaly_score", "forest_score", "is_anomalous")


@query
def anomaly_scores(spark, folder):
    return _scored(spark, folder)


@query
def anomalous_logs(spark, folder):
    return _scored(spark, folder).where("is_anomalous")


@query
def log_risk(spark, folder):
    return forest.log_risk(_scored(spark, folder))


# Table changes


@query
def update_one(spark, folder):
    return updates.update_one(
        incidents(spark, folder), {"status": "open", "severity": "critical"}, {"assigned_to": "lead", "status": "investigating"},
        "incident_id")


@query
def update_many(spark, folder):
    return updates.update_many(incidents(spark, folder), {"status": "open", "severity": ["critical", "high"]}, {"assigned_to": "lead"})


@query
def update_count(spark, folder):
    return updates.affected(incidents(spark, folder), {"status": "open", "severity": ["critical", "high"]})


@query
def delete_matching(spark, folder):
    return updates.delete_matching(incidents(spark, folder), {"status": "resolved", "created_at": {"$lte": F.lit("1996-01-01").cast("timestamp")}})


@query
def alerts_acknowledged(spark, folder):
    done = alert_commands(spark, folder).where("cmd = 'acknowledge'")
    return updates.acknowledge(alerts(spark, folder), done).select(
        "alert_id", "log_id", "rule_name", "acknowledged", "acknowledged_by", "ack_notes")


@query
def escalated_incidents(spark, folder):
    return updates.escalate(alerts(spark, folder), alert_commands(spark, folder).where("cmd = 'escalate'"))


@query
def escalation_timeline(spark, folder):
    return updates.escalation_timeline(updates.escalate(
        alerts(spark, folder), alert_commands(spark, folder).where("cmd = 'escalate'")))


@query
def alerts_linked(spark, folder):
    linked = updates.link_alerts(alerts(spark, folder), alert_commands(spark, folder).where("cmd = 'escalate'"))
    return linked.select("alert_id", "log_id", "rule_name", "incident_id")


@query
def incidents_created(spark, folder):
    return updates.create_incidents(requests(spark, folder))


def _decisions(spark, folder):
    return cases.decide(D.derived(spark, folder, "incidents"), D.derived(spark, folder, "commands"))


@query
def incidents_updated(spark, folder):
    found = D.derived(spark, folder, "incidents").select("incident_id", "title", "status", "severity", "assigned_to")
    return cases.snapshot(found, _decisions(spark, folder))


@query
def incident_transitions(spark, folder):
    return cases.status_changes(_decisions(spark, folder))


@query
def incident_notes(spark, folder):
    return cases.notes(_decisions(spark, folder))


@query
def commands_rejected(spark, folder):
    return cases.rejected(_decisions(spark, folder))


@query
def iocs_created(spark, folder):
    return updates.create_indicators(requests(spark, folder))


@query
def iocs_remaining(spark, folder):
    withdrawn = spark.read.parquet(f"{folder}/events.parquet").where("event_type = 'error'").select(
        (F.col("user_id") * 2).alias("ioc_id")).distinct()
    return updates.delete_keys(D.derived(spark, folder, "indicators"), withdrawn, "ioc_id")


# Scalar functions and live counters


@query
def format_bytes(spark, folder):
    lines = spark.read.parquet(f"{folder}/orders.parquet")
    return lines.select("o_orderkey", T.format_bytes(F.floor(F.col("o_totalprice") * F.col("o_custkey") * 40)).alias("size"))


@query
def time_ago(spark, folder):
    found = D.derived(spark, folder, "logs")
    return found.select("log_id", T.time_ago("created_at", as_of(found)).alias("age"))


@query
def severity_order(spark, folder):
    return D.derived(spark, folder, "logs").select("log_id", behaviour.severity_rank(F.col("severity")).alias("rank"))


@query
def notify_alerts(spark, folder):
    return to_notify(alerts(spark, folder)).select("alert_id", "severity", "title")


@query
def unread_alerts(spark, folder):
    return unread(alerts(spark, folder), F.lit("2024-01-20").cast("timestamp"))


@query
def message_envelope(spark, folder):
    found = alerts(spark, folder).select(
        "alert_id", "severity", "title", F.col("log_id").cast("string").alias("log_id"))
    return envelope(found, "alert").select("value")


# Streaming: the events file as a stream, run to its end


def _stream(spark, folder, name):
    return D.derive(read_stream(spark, folder, EVENTS_INPUT, "events.parquet"), name)


def _drained(spark, stream):
    place = _place(spark)
    to_files(stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@query
def stream_eps(spark, folder):
    return _drained(spark, events_per_second(_stream(spark, folder, "burst"), "10 seconds"))


@query
def stream_user_hours(spark, folder):
    return _drained(spark, events_per_hour(_stream(spark, folder, "logs"), "10 minutes"))


def _ingested(spark, folder):
    place = _place(spark)
    stream, job = _stream(spark, folder, "burst"), Ingest(spark, f"{place}/tables")
    job.start(stream, f"{place}/checkpoint", available_now=True).awaitTermination()
    job.finish(stream.schema)
    return job


@query
def stream_alerts(spark, folder):
    """Every alert of the live pipeline, with its message counted as published."""
    found = _ingested(spark, folder).table("alerts")
    return found.select("alert_id", "log_id", "rule_name", "severity", "title", "description")


@query
def stream_messages(spark, folder):
    sent = opened(_ingested(spark, folder).table("messages"), "type string, data struct<severity: string>")
    return sent.groupBy("type", "severity").agg(F.count("*").alias("n"))


@query
def stream_risk_history(spark, folder):
    place = _place(spark)
    job = Ingest(spark, f"{place}/tables")
    job.start_profiles(_stream(spark, folder, "logs"), f"{place}/checkpoint", available_now=True).awaitTermination()
    return job.risk_profiles()


@query
def stream_unread(spark, folder):
    """Alerts of the stateless rules since the last mark, every thousandth log being a read mark."""
    place, live = _place(spark), _stream(spark, folder, "burst")
    counts = unread_counts(detection.stateless_alerts(live, texts=False), live.where("log_id % 1000 = 999"))
    save = lambda df, batch: df.write.mode("overwrite").parquet(f"{place}/counts/batch={batch}")
    writer = counts.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(save)
    writer.option("checkpointLocation", f"{place}/checkpoint").start().awaitTermination()
    return unread_now(spark.read.parquet(f"{place}/counts"))


@query
def stream_buffer(spark, folder):
    place = _place(spark)
    buffer = LiveBuffer(spark, f"{place}/buffer", 500)
    live = _stream(spark, folder, "logs").select("log_id", "created_at", "severity", "message")
    buffer.start(live, f"{place}/checkpoint", available_now=True).awaitTermination()
    return buffer.table()
