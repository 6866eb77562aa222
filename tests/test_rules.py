"""Rules on hand-written logs: at, below and above each threshold."""

from datetime import datetime, timedelta

import pytest

from watchkeep.plans.detection import all_alerts, qualifying, stateless_alerts, threshold_alerts, undecided
from watchkeep.plans.rules import Rule, beaconing, brute_force, default_rules, port_scan
from watchkeep.schemas import LOGS

START = datetime(2024, 5, 1)


def make(spark, rows):
    full = []
    for i, row in enumerate(rows):
        given = dict(row)
        entry = {f.name: None for f in LOGS.fields}
        entry.update({"log_id": f"{i:06d}", "created_at": START + timedelta(seconds=given.pop("at", i))}, **given)
        full.append(tuple(entry[f.name] for f in LOGS.fields))
    return spark.createDataFrame(full, LOGS)


def fired(spark, rows, rules=None):
    return sorted((a.rule_name, int(a.log_id)) for a in all_alerts(make(spark, rows), rules).collect())


def test_brute_force_needs_ten_within_two_minutes(spark):
    attempt = lambda at, ip="9.9.9.9": {"at": at, "event_type": "ssh_failed_login", "source_ip": ip}
    assert fired(spark, [attempt(i) for i in range(9)], [brute_force()]) == []
    assert fired(spark, [attempt(i) for i in range(10)], [brute_force()]) == [("brute_force", 9)]
    assert fired(spark, [attempt(i) for i in range(19)], [brute_force()]) == [("brute_force", 9)]
    assert fired(spark, [attempt(i) for i in range(20)], [brute_force()]) == [("brute_force", 9), ("brute_force", 19)]
    # The first attempt is exactly two minutes old when the tenth arrives.
    assert fired(spark, [attempt(0)] + [attempt(120)] * 9, [brute_force()]) == []
    assert fired(spark, [attempt(1)] + [attempt(120)] * 9, [brute_force()]) == [("brute_force", 9)]


def test_brute_force_predicates(spark):
    rows = [{"event_id": 4625}] * 5 + [{"message": "x Failed password y"}] * 4 + [{"message": "failed password"}]
    assert fired(spark, rows, [brute_force()]) == []
    assert fired(spark, rows[:-1] + [{"event_type": "failed_logon_attempt"}], [brute_force()]) == [("brute_force", 9)]


def test_port_scan_counts_distinct_non_zero_ports(spark):
    probe = lambda at, port, action="DENY": {
        "at": at, "log_source": "firewall", "action": action, "dest_port": port, "source_ip": "8.8.8.8"}
    nineteen = [probe(i, i + 1) for i in range(19)]
    assert fired(spark, nineteen + [probe(20, 0), probe(21, None), probe(22, 5), probe(23, 99, "ALLOW")], [port_scan()]) == []
    assert fired(spark, nineteen + [probe(20, 20, "DROP")], [port_scan()]) == [("port_scan", 19)]
    assert fired(spark, nineteen + [probe(60, 20)], [port_scan()]) == []


def test_beaconing_ignores_internal_targets(spark):
    hit = lambda at, ip: {"at": at, "log_source": "netflow", "hostname": "h", "dest_ip": ip}
    for ip, expected in (("192.168.1.5", []), ("10.1.1.1", []), ("172.16.0.1", [("beaconing", 7)]), ("7.7.7.7", [("beaconing", 7)])):
        assert fired(spark, [hit(i, ip) for i in range(8)], [beaconing()]) == expected
    blocked = [{**hit(i, "7.7.7.7"), "action": "DENY"} for i in range(8)]
    assert fired(spark, blocked, [beaconing()]) == []
    by_source = [{"at": i, "log_source": "ids_ips", "hostname": "h", "dest_ip": "", "source_ip": "7.7.7.7"} for i in range(8)]
    assert fired(spark, by_source, [beaconing()]) == [("beaconing", 7)]


def test_composite_keys_do_not_run_together(spark):
    rows = [{"at": i, "log_source": "netflow", "hostname": h, "dest_ip": d} for i, (h, d) in enumerate(
        [("a|b", "c")] * 4 + [("a", "b|c")] * 4)]
    assert fired(spark, rows, [beaconing()]) == []


def test_stateless_rules_and_texts(spark):
    rows = [
        {"event_id": 4672, "hostname": "dc1", "username": "eve"},
        {"message": "User ADDED TO Domain Admins"},
        {"process": "PwSh.exe", "raw_log": "run -Enc JAB", "message": " Hidden IEX(x) webclient", "hostname": "w1"},
        {"process": "cmd.exe", "raw_log": "mimikatz"},
        {"event_type": "impossible_travel", "username": "bob"},
        {"bytes_out": 10_000_000, "hostname": "f1", "dest_ip": "5.5.5.5"},
        {"bytes_out": 9_999_999},
        {"message": "EXFIL found"},
        {"process": "Rubeus.EXE", "hostname": "w2"},
        {"signature": "ET TROJAN " + "x" * 60},
        {"event_type": "malware_execution"},
        {},
    ]
    found = {(a.rule_name, int(a.log_id)): a for a in stateless_alerts(make(spark, rows)).collect()}
    assert sorted(found) == [
        ("data_exfiltration", 5), ("data_exfiltration", 7), ("impossible_travel", 4), ("malware_indicators", 8),
        ("malware_indicators", 9), ("malware_indicators", 10), ("privilege_escalation", 0), ("privilege_escalation", 1),
        ("suspicious_powershell", 2),
    ]
    assert found["privilege_escalation", 0].description == "User eve performed a privilege escalation action (EventID 4672) on dc1"
    assert "(EventID None) on unknown" in found["privilege_escalation", 1].description
    assert "[-enc , iex(, hidden] by unknown on w1" in found["suspicious_powershell", 2].description
    assert found["impossible_travel", 4].description == "Impossible travel login detected"
    assert "10MB from f1 to 5.5.5.5" in found["data_exfiltration", 5].description
    assert "0MB from" in found["data_exfiltration", 7].description
    assert "[rubeus.exe]" in found["malware_indicators", 8].description
    assert f"[{('et trojan ' + 'x' * 60)[:40]}]" in found["malware_indicators", 9].description
    assert "[malware pattern]" in found["malware_indicators", 10].description


def test_one_log_may_raise_several_alerts(spark):
    rows = [{"event_id": 4720, "message": "mimikatz exfil", "process": "powershell.exe", "raw_log": "invoke-expression " + "z" * 300}]
    alerts = stateless_alerts(make(spark, rows)).collect()
    assert len(alerts) == 4 and len({a.alert_id for a in alerts}) == 4
    assert {len(a.raw_log_snippet) for a in alerts} == {200}


@pytest.mark.parametrize("partitions", [2, 5])
def test_alerts_do_not_depend_on_partitions(spark, small, partitions):
    from checks.derived import derived

    logs = derived(spark, small, "burst")
    ids = lambda df: sorted(r.alert_id for r in df.select("alert_id").collect())
    assert ids(threshold_alerts(logs.repartition(7), partitions=partitions)) == ids(threshold_alerts(logs))


def test_golden_counts(spark):
    """Counted by a sequential loop over the derived tables."""
    from checks.derived import derived

    counts = all_alerts(derived(spark, "/root/testdata/sf0.01", "burst")).groupBy("rule_name").count().collect()
    assert dict(map(tuple, counts)) == {
        "brute_force": 71, "port_scan": 84, "beaconing": 115, "privilege_escalation": 794, "data_exfiltration": 265,
        "impossible_travel": 215, "malware_indicators": 575, "suspicious_powershell": 324,
    }


def test_user_rule(spark):
    from pyspark.sql import functions as F
    from watchkeep.operators.thresholds import Threshold

    mine = Rule(
        name="many_errors", severity="low", techniques=[], tags=["web"], when=F.col("status_code") >= 500,
        title=F.concat(F.lit("Errors on "), F.col("url_path")), description=F.lit("three in ten seconds"),
        threshold=Threshold(3, 10), key=F.col("hostname"), carry=("url_path",))
    rows = [{"hostname": "w", "status_code": 503, "url_path": "/a"}] * 3
    alerts = all_alerts(make(spark, rows), [mine]).collect()
    assert [(a.rule_name, a.title, a.log_id) for a in alerts] == [("many_errors", "Errors on /a", "000002")]
    assert len(all_alerts(make(spark, rows), [*default_rules(), mine]).collect()) == 1


def test_a_rule_that_meets_an_error_is_skipped_for_that_log(spark):
    from pyspark.sql import functions as F

    def rule(name, when, title=None):
        return Rule(name=name, severity="low", techniques=[], tags=[], when=when, title=F.lit(name) if title is None else title, description=F.lit("d"))

    number = F.col("message").cast("int")
    mine = [
        rule("number", number > 5), rule("share", F.lit(10) / number > 1), rule("piece", F.element_at(F.split("message", ","), 2) == "b"),
        rule("named", F.col("message").isNotNull(), F.concat(F.lit("n"), number.cast("string"))), rule("plain", F.col("message").contains("7")),
    ]
    rows = [{"message": m} for m in ("7", "text", "0", "a,b", None, "3")]
    logs = make(spark, rows)
    ids = {r["log_id"]: r["message"] for r in logs.select("log_id", "message").collect()}
    found = sorted((a["rule_name"], str(ids[a["log_id"]])) for a in all_alerts(logs, mine).select("rule_name", "log_id").collect())
    assert found == sorted([("number", "7"), ("share", "7"), ("share", "3"), ("piece", "a,b"), ("plain", "7"),
                            *[("named", m) for m in ("7", "text", "0", "a,b", "3")]])
    told = {(r["rule_name"], str(ids[r["log_id"]])) for r in undecided(logs, mine).collect()}
    assert ("number", "text") in told and ("share", "0") in told and ("number", "3") not in told and ("named", "text") not in told
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
