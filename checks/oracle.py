"""The same queries as DuckDB SQL, written independently of the operators."""

from __future__ import annotations

from checks.registry import TEST_FEED_HASHES, TEST_FEED_IPS
from watchkeep import constants as C
from checks.derived import duckdb_sql

ORACLE: dict[str, str] = {}

WORDS = {t: f"case when {t} is null then 'unknown' else {t} end" for t in ("hostname", "username", "source_ip", "dest_ip")}
HOST, USER, SOURCE, DEST = WORDS["hostname"], WORDS["username"], WORDS["source_ip"], WORDS["dest_ip"]
LOW = "lower(coalesce(message, ''))"
SIG = "lower(coalesce(signature, ''))"
PROC = "lower(coalesce(process, ''))"
CMD = "lower(concat(coalesce(raw_log, ''), coalesce(message, ''), coalesce(powershell_payload, '')))"


def _list(values):
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _array(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _values(rows, name, columns):
    def cell(v):
        return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as {name}({columns})"


def _any(text, phrases):
    return f"len(list_filter({_array(phrases)}, lambda p: contains({text}, p))) > 0"


def _rule(name, severity, mitre, tags, when, title, description, table):
    return (
        f"select log_id, created_at, '{name}' as rule_name, '{severity}' as severity, {title} as title, {description} as description,"
        f" '{mitre}' as mitre_csv, '{tags}' as tags_csv, coalesce(source_ip, '') as source_ip, coalesce(hostname, '') as hostname,"
        f" coalesce(username, '') as username, substr(coalesce(raw_log, ''), 1, 200) as raw_log_snippet from {table} where {when}"
    )


STATELESS = {
    "rule_privilege_escalation": lambda t: _rule(
        "privilege_escalation", "critical", "T1078.002,T1098,T1134", "privilege_escalation,persistence,credential_access",
        f"coalesce(event_id in {_list(C.PRIVILEGE_IDS)}, false) or event_type = 'privilege_escalation' or {_any(LOW, C.PRIVILEGE_PHRASES)}",
        f"concat('Privilege Escalation on ', {HOST})",
        f"concat('User ', {USER}, ' performed a privilege escalation action (EventID ', coalesce(cast(event_id as varchar), 'None'), ') on ', {HOST})", t),
    "rule_powershell": lambda t: _rule(
        "suspicious_powershell", "critical", "T1059.001,T1027,T1140", "powershell,execution,defense_evasion",
        f"({PROC} in {_list(C.POWERSHELL_PROCESSES)} or contains({LOW}, 'powershell') or event_type = 'suspicious_powershell') and {_any(CMD, C.POWERSHELL_PATTERNS)}",
        f"concat('Suspicious PowerShell Activity on ', {HOST})",
        f"concat('Suspicious PowerShell patterns detected: [', array_to_string(list_filter({_array(C.POWERSHELL_PATTERNS)}, lambda p: contains({CMD}, p))[1:3], ', '), '] by ', {USER}, ' on ', {HOST})", t),
    "rule_impossible_travel": lambda t: _rule(
        "impossible_travel", "high", "T1078,T1534", "impossible_travel,account_compromise,anomaly",
        "event_type = 'impossible_travel'", f"concat('Impossible Travel Detected for ', {USER})",
        "coalesce(message, 'Impossible travel login detected')", t),
    "rule_exfiltration": lambda t: _rule(
        "data_exfiltration", "critical", "T1041,T1048,T1030", "data_exfiltration,exfiltration,insider_threat",
        f"event_type = 'data_exfiltration' or coalesce(bytes_out, 0) >= {C.EXFILTRATION_BYTES} or contains({LOW}, 'exfil')",
        f"concat('Data Exfiltration Detected from ', {HOST})",
        f"concat('Large outbound data transfer detected: ', cast(coalesce(bytes_out, 0) // 1000000 as varchar), 'MB from ', {HOST}, ' to ', {DEST})", t),
    "rule_malware": lambda t: _rule(
        "malware_indicators", "critical", "T1059,T1055,T1036,T1071", "malware,execution,c2,edr",
        f"{PROC} in {_list(C.MALWARE_PROCESSES)} or {_any(LOW, C.MALWARE_PHRASES)} or {_any(SIG, C.MALWARE_PHRASES)} or event_type = 'malware_execution'",
        f"concat('Malware Indicator Detected on ', {HOST})",
        f"concat('Known malware indicator [', case when {PROC} in {_list(C.MALWARE_PROCESSES)} then {PROC} when {SIG} <> '' then substr({SIG}, 1, 40) else 'malware pattern' end, '] detected on ', {HOST}, ' by user ', {USER})", t),
}

TARGET = "case when coalesce(dest_ip, '') <> '' then dest_ip else coalesce(source_ip, '') end"


def _count_rule(count, seconds, key, when, table):
    """Rows of ``table`` that fire a count threshold with reset.

    A row is a candidate if the row ``count - 1`` places back is inside the
    window; after a firing at place r, the next is the first candidate from
    r + count on.
    """
    return f"""q as (select *, epoch_us(created_at) as us, {key} as k, row_number() over w as rn,
      lag(epoch_us(created_at), {count - 1}) over w as old from {table} where {when} window w as (partition by {key} order by created_at, log_id)),
    cand as (select *, min(rn) over (partition by k order by rn range between {count} following and unbounded following) as nxt
      from q where us - old < {seconds * 1_000_000}),
    fire(k, rn, nxt) as (select k, rn, nxt from (select *, row_number() over (partition by k order by rn) as pos from cand) where pos = 1
      union all select c.k, c.rn, c.nxt from fire f join cand c on c.k = f.k and c.rn = f.nxt),
    fired as (select q.* from q join fire on q.k = fire.k and q.rn = fire.rn)"""


def _distinct_rule(count, seconds, key, value, when, table):
    """As above for distinct values: ``seen`` is the last place of the
    ``count``-th most recent value; a row fires if that lies after the last firing."""
    return f"""q as (select *, epoch_us(created_at) as us, {key} as k, row_number() over (partition by {key} order by created_at, log_id) as rn
      from {table} where {when}),
    recent as (select i.k, i.rn, j.{value}, max(j.rn) as seen from q i join q j
      on j.k = i.k and j.rn <= i.rn and i.us - j.us < {seconds * 1_000_000} group by i.k, i.rn, j.{value}),
    cand as (select k, rn, seen from (select *, row_number() over (partition by k, rn order by seen desc) as pos from recent) where pos = {count}),
    step as (select a.k, a.rn, min(b.rn) as nxt from cand a left join cand b on b.k = a.k and b.seen > a.rn group by a.k, a.rn),
    fire(k, rn, nxt) as (select k, rn, nxt from (select *, row_number() over (partition by k order by rn) as pos from step) where pos = 1
      union all select s.k, s.rn, s.nxt from fire f join step s on s.k = f.k and s.rn = f.nxt),
    fired as (select q.* from q join fire on q.k = fire.k and q.rn = fire.rn)"""


THRESHOLD = {
    "rule_brute_force": (
        lambda t: _count_rule(10, 120, SOURCE,
            "event_type in ('failed_logon_attempt', 'ssh_failed_login') or coalesce(event_id = 4625, false) or contains(coalesce(message, ''), 'Failed password')", t),
        lambda t: _rule("brute_force", "high", "T1110.001,T1078", "brute_force,authentication,lateral_movement", "true",
            f"concat('Brute Force Attack Detected from ', {SOURCE})",
            f"concat('10 failed login attempts from ', {SOURCE}, ' within 120s on host ', {HOST})", t)),
    "rule_port_scan": (
        lambda t: _distinct_rule(20, 60, SOURCE, "dest_port", "log_source = 'firewall' and action in ('DENY', 'DROP') and coalesce(dest_port, 0) <> 0", t),
        lambda t: _rule("port_scan", "medium", "T1046", "port_scan,reconnaissance,network", "true",
            f"concat('Port Scan Detected from ', {SOURCE})",
            f"concat('Source ', {SOURCE}, ' scanned 20 unique ports on ', {DEST}, ' within 60s')", t)),
    "rule_beaconing": (
        lambda t: _count_rule(8, 300, f"concat({HOST}, '|', {TARGET})",
            f"log_source in ('firewall', 'netflow', 'ids_ips') and coalesce(action, 'ALLOW') = 'ALLOW' and {TARGET} <> '' and not starts_with({TARGET}, '192.168.') and not starts_with({TARGET}, '10.')", t),
        lambda t: _rule("beaconing", "high", "T1071.001,T1102,T1008", "c2,beaconing,command_control,persistence", "true",
            f"concat('C2 Beaconing Detected: ', {HOST}, ' → ', {TARGET})",
            f"concat({HOST}, ' made 8 periodic connections to ', {TARGET}, ' within 300s — possible C2 beacon')", t)),
}


def _id(*parts):
    return "sha256(concat_ws('|', " + ", ".join(parts) + "))"


ALERT_ID = _id("cast(log_id as varchar)", "rule_name")


def _alerts(table):
    return " union all ".join(f"({make(table)})" for make in STATELESS.values())


def _everything():
    ctes, parts = [], [_alerts("burst")]
    for number, (make, texts) in enumerate(THRESHOLD.values()):
        body = make("burst")
        for cte in ("q", "cand", "fire", "fired", "recent", "step"):
            for before, after in ((f"{cte} as (", f"{cte}{number} as ("), (f"{cte}(k,", f"{cte}{number}(k,"), (f"from {cte} ", f"from {cte}{number} "),
                                  (f"join {cte} ", f"join {cte}{number} "), (f"from {cte})", f"from {cte}{number})"), (f"select {cte}.*", f"select {cte}{number}.*"),
                                  (f"on {cte}.k", f"on {cte}{number}.k"), (f"= {cte}.k", f"= {cte}{number}.k"), (f"and {cte}.rn", f"and {cte}{number}.rn"), (f"= {cte}.rn", f"= {cte}{number}.rn")):
                body = body.replace(before, after)
        ctes.append(body)
        parts.append(texts(f"fired{number}"))
    return ",\n".join(ctes), " union all ".join(f"({p})" for p in parts)


_CTES, _ALL = _everything()


TABLES = {name: duckdb_sql(name) for name in (
    "logs", "burst", "indicators", "incidents", "commands", "alert_commands", "requests", "web")}
TABLES["alerts"] = f"select {ALERT_ID} as alert_id, *, log_id % 3 = 0 as acknowledged from ({_ALL})"
TABLES["alert_cmds"] = f"select *, {_id('cast(log_id as varchar)', 'rule_name')} as alert_id from alert_commands"
NEEDS = {"alerts": ["logs", "burst"], "alert_cmds": ["alert_commands"]}


def sql(name, body, *tables, extra="", recursive=False):
    needed = []
    for t in tables:
        needed += [n for n in NEEDS.get(t, []) if n not in needed]
        needed += [t] if t not in needed else []
    ctes = [(_CTES + ",\n" if t == "alerts" else "") + f"{t} as materialized ({TABLES[t]})" for t in needed] + ([extra] if extra else [])
    recursive = recursive or "alerts" in needed
    ORACLE[name] = ("with " + ("recursive " if recursive else "") + ",\n".join(ctes) + "\n" if ctes else "") + body


LOG_COLUMNS = (
    "log_id, epoch_us(created_at) as created_at, log_source, event_id, event_type, severity, hostname, username, source_ip, dest_ip,"
    " dest_port, action, process, signature, status_code, bytes_out, message, raw_log, powershell_payload, country, geo_lat, geo_lon,"
    " risk_score, anomaly_score, mitre_csv as mitre_techniques"
)
ALERT_COLUMNS = (
    "alert_id, epoch_us(created_at) as created_at, title, description, severity, rule_name, source_ip, hostname, username, log_id,"
    " mitre_csv as mitre_techniques, tags_csv as tags, acknowledged, cast(null as varchar) as acknowledged_by,"
    " cast(null as varchar) as incident_id, raw_log_snippet"
)
NEWEST = "order by created_at desc, log_id desc"
NEWEST_ALERT = "order by {t}created_at desc, {t}alert_id desc".format(t="")
KEYWORD = "(contains(lower(coalesce(message, '')), '{w}') or contains(lower(coalesce(raw_log, '')), '{w}') or contains(lower(coalesce(hostname, '')), '{w}') or contains(lower(coalesce(source_ip, '')), '{w}'))"
ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f')"

# Sources and sinks
sql("read_logs", f"select {LOG_COLUMNS} from logs", "logs")
sql("export_logs", f"select {ISO} as created_at, severity, event_type, hostname, source_ip, log_source, message, raw_log from (select * from logs {NEWEST} limit 1000)", "logs")
sql("export_all_logs", f"select {ISO} as created_at, severity, event_type, hostname, source_ip, log_source, message, raw_log from logs", "logs")
sql("export_alerts", f"select {ISO} as created_at, severity, title, rule_name, source_ip, hostname, cast(acknowledged as varchar) as acknowledged, mitre_csv as mitre_techniques from (select * from alerts {NEWEST_ALERT} limit 500)", "alerts")
sql("export_incidents", f"select {ISO} as created_at, title, severity, status, assigned_to, source_ip, hostname, mitre_csv as mitre_techniques from (select * from incidents order by created_at desc, incident_id desc limit 500)", "incidents")
sql("message_envelope", "select cast(json_object('type', 'alert', 'data', json_object('alert_id', alert_id, 'severity', severity, 'title', title, 'log_id', cast(log_id as varchar))) as varchar) as value from alerts", "alerts")

# Filters and projections
sql("logs_equality_filter", f"select {LOG_COLUMNS} from logs where severity = 'high' and log_source = 'windows_event'", "logs")
ORACLE["filter_language"] = """select * from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 1000.5 and o_totalprice <= 400000.0
  and o_custkey > 10 and (o_orderpriority is null or o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')) and o_orderpriority is distinct from '2-HIGH'"""
sql("logs_keyword", f"select {LOG_COLUMNS} from logs where {KEYWORD.format(w='powershell')}", "logs")
ORACLE["variant_filter"] = """select event_id as id, case event_id % 5 when 0 then k else k || '.5' end as level,
    case event_id % 5 when 0 then event_type else '["' || event_type || '"]' end as kind
  from (select *, json_extract_string(props, '$.k') as k from events)
  where (event_id % 5 = 0 and cast(k as int) >= 40 and event_type <> 'view') or (event_id % 5 = 2 and cast(k as int) >= 40)"""
ORACLE["corrupt_lines"] = """select '{"id": ' || event_id || ', "kind": "' || event_type as value from events where event_id % 5 = 4"""
ORACLE["logs_keyword_indexed"] = ORACLE["logs_keyword"]
sql("log_search_page", f"select {LOG_COLUMNS}, total from (select *, (select count(*) from logs where log_source = 'windows_event') as total from logs where log_source = 'windows_event' {NEWEST} limit 100 offset 20) where {KEYWORD.format(w='host-1')}", "logs")
sql("log_search_all", f"select {LOG_COLUMNS}, total from (select *, count(*) over () as total from logs where log_source = 'windows_event' and {KEYWORD.format(w='host-1')} {NEWEST} limit 100 offset 20)", "logs")
sql("live_feed_filter", f"select {LOG_COLUMNS} from logs where severity = 'high' and (contains(lower(message), 'web') or contains(source_ip, 'Web') or contains(lower(hostname), 'web'))", "logs")
sql("alerts_list", f"select {ALERT_COLUMNS}, total from (select *, count(*) over () as total from alerts where severity = 'critical' and not acknowledged and rule_name = 'malware_indicators' {NEWEST_ALERT} limit 50 offset 10)", "alerts")
INCIDENT_COLUMNS = "incident_id, epoch_us(created_at) as created_at, title, description, severity, status, assigned_to, source_ip, hostname, mitre_csv as mitre_techniques"
sql("incidents_list", f"select {INCIDENT_COLUMNS}, total from (select *, count(*) over () as total from incidents where status = 'open' and severity = 'high' and assigned_to = 'analyst1' order by created_at desc, incident_id desc limit 50 offset 5)", "incidents")
IOC_TIME = "(ioc_id * 7919) % 100003"
IOC_COLUMNS = "ioc_id, ioc_type, value, threat_type, confidence, active, threat_type as tags, (ioc_id * 7919) % 100003 * 1000000 as created_at"
sql("iocs_list", f"select {IOC_COLUMNS}, total from (select *, count(*) over () as total from indicators where ioc_type = 'ip' order by {IOC_TIME} desc, ioc_id desc limit 50 offset 3)", "indicators")
sql("find_newest", f"select {LOG_COLUMNS} from (select * from logs where username = 'user7' and severity <> 'info' {NEWEST} limit 1)", "logs")
sql("newest_per_user", f"select {LOG_COLUMNS} from (select *, row_number() over (partition by username {NEWEST}) as place from logs where username is not null) where place = 1", "logs")
sql("blocklist", f"select {IOC_COLUMNS} from indicators where active", "indicators")
sql("blocklist_recent", f"select {IOC_COLUMNS} from (select * from indicators where active order by {IOC_TIME} desc, ioc_id desc limit 500)", "indicators")
sql("page_past_the_end", "select cast(null as varchar) as incident_id, count(*) as total from incidents where status = 'open'", "incidents")
GEO = "select log_id, source_ip, coalesce(country, 'Unknown') as country, geo_lat as lat, geo_lon as lon, severity, event_type from {t}"
sql("geo_attacks", GEO.format(t=f"(select * from logs where geo_lat is not null {NEWEST} limit 200)"), "logs")
_DETAIL = {
    "created_at": ISO, "severity": "severity", "username": "username", "dest_port": "cast(dest_port as varchar)", "message": "message",
    "mitre_techniques": "replace(mitre_csv, ',', ', ')", "country": "country", "risk_score": "cast(risk_score as varchar)"}
sql("log_detail", " union all ".join(f"select log_id, '{n}' as field, coalesce({e}, '—') as value from logs" for n, e in _DETAIL.items()), "logs")
sql("log_sources", f"select s.log_source, count(l.log_id) as n from {_values([(s,) for s in C.LOG_SOURCES], 's', 'log_source')} left join logs l on l.log_source = s.log_source group by 1", "logs")

# Sorting
sql("sorted_page", f"select {LOG_COLUMNS} from (select * from logs order by risk_score, log_id limit 70 offset 30)", "logs")
sql("deep_page", f"select {LOG_COLUMNS} from (select *, row_number() over ({NEWEST}) as place, count(*) over () as total from logs) where place > total * 2 // 3 and place <= total * 2 // 3 + 100", "logs")
sql("live_logs", f"select {LOG_COLUMNS} from (select * from logs {NEWEST} limit 50)", "logs")
sql("recent_alerts", f"select {ALERT_COLUMNS} from (select * from alerts {NEWEST_ALERT} limit 20)", "alerts")
sql("live_buffer", f"select 'log' as kind, cast(log_id as varchar) as id, epoch_us(created_at) as created_at from (select * from logs {NEWEST} limit 500) union all select 'alert', alert_id, epoch_us(created_at) from (select * from alerts {NEWEST_ALERT} limit 100)", "alerts")

# Joins and look-ups
HASH_SCORE = "cast(cast(('0x' || substr(md5(ip), 1, 6)) as int) % 21 + {low} as int)"
sql("ip_reputation", f"""select ip, case when f is not null then {HASH_SCORE.format(low=75)} when confidence is not null then confidence else {HASH_SCORE.format(low=5)} end as risk_score,
  f is not null or confidence is not null as is_malicious, f is not null as threat_feed_match, confidence is not null as ioc_match,
  case when f is not null then 'threat_feed_match,known_malicious' when confidence is not null then concat(threat_type, ',ioc_match') else 'clean' end as tags
  from (select distinct source_ip as ip from logs) left join {_values([(v,) for v in C.FEED_IPS + TEST_FEED_IPS], 'feed', 'f')} on f = ip
  left join (select value, arg_max(confidence, row((ioc_id * 7919) % 100003, ioc_id)) as confidence, arg_max(threat_type, row((ioc_id * 7919) % 100003, ioc_id)) as threat_type from indicators where ioc_type = 'ip' group by 1) on value = ip""", "logs", "indicators")
sql("hash_reputation", f"""select value as hash, h is not null as is_malicious, case when h is not null then 'malware' else 'unknown' end as threat_type, cast(case when h is not null then 95 else 5 end as int) as risk_score
  from (select distinct value from indicators where ioc_type = 'hash') left join {_values([(v,) for v in C.FEED_HASHES + TEST_FEED_HASHES], 'feed', 'h')} on h = value""", "indicators")
ESCALATION = _id("'escalation'", "cast(c.cmd_id as varchar)")
sql("alert_incident_link", f"select a.alert_id, {ESCALATION} as incident_id, concat('[Escalated] ', a.title) as incident_title, 'open' as status, a.rule_name, epoch_us(a.created_at) as created_at from alerts a join alert_cmds c on c.alert_id = a.alert_id and c.cmd = 'escalate'", "alerts", "alert_cmds")
sql("alerts_with_logs", "select a.log_id, a.alert_id, a.rule_name, a.title, l.message as log_message, l.event_type as log_event_type, l.risk_score as log_risk_score from alerts a join burst l on l.log_id = a.log_id", "alerts")
TACTICS = _values(list(C.TACTICS.items()), "m", "technique, tactic")
USED = "(select unnest(string_split(mitre_csv, ',')) as technique from alerts)"
sql("tactic_counts", f"select coalesce(m.tactic, 'Unknown') as tactic, count(*) as n from {USED} t left join {TACTICS} on m.technique = t.technique group by 1", "alerts")
sql("tactic_counts_by_parent", f"select coalesce(m.tactic, p.tactic, 'Unknown') as tactic, count(*) as n from {USED} t left join {TACTICS} on m.technique = t.technique left join {TACTICS.replace(' as m(', ' as p(')} on p.technique = string_split(t.technique, '.')[1] group by 1", "alerts")
sql("enrich_event_id", f"select l.event_id, log_id, m.d as event_description, m.s as event_severity, coalesce(m.t, '') as event_techniques from logs l left join {_values([(i, d, s, ','.join(t)) for i, (d, s, t) in C.HOST_EVENTS.items()], 'm', 'i, d, s, t')} on m.i = l.event_id", "logs")
sql("enrich_signature", f"select l.signature, log_id, m.s as signature_severity, coalesce(m.t, '') as signature_techniques from logs l left join {_values([(n, s, ','.join(t)) for n, (s, t) in C.SIGNATURES.items()], 'm', 'n, s, t')} on m.n = l.signature", "logs")
sql("geo_positions", f"select coalesce(l.country, 'Unknown') as country, log_id, cast(coalesce(m.x, 50) as int) as x, cast(coalesce(m.y, 50) as int) as y from logs l left join {_values([(n, x, y) for n, (x, y) in C.COUNTRY_POSITIONS.items()], 'm', 'n, x, y')} on m.n = coalesce(l.country, 'Unknown') where geo_lat is not null", "logs")
sql("enrich_http_severity", f"select log_id, status_code, url_path, case when url_path in {_list(C.SENSITIVE_PATHS)} then 'high' when status_code < 400 then 'info' when status_code < 500 then 'medium' when status_code is not null then 'high' end as http_severity from web", "web")
sql("enrich_http_mitre", "select log_id, status_code, url_path, case when status_code in (200, 201) and starts_with(url_path, '/admin') then 'T1190' else '' end as http_techniques from web", "web")
sql("enrich_firewall", "select log_id, action, severity, case when action = 'ALLOW' then 'T1071' else '' end as flow_techniques, case when action = 'ALLOW' then 'low' else severity end as flow_severity from logs where log_source = 'firewall'", "logs")

# Aggregates
sql("count_matching", "select count(*) as n from logs where severity in ('high', 'critical') and risk_score >= 50", "logs")
sql("severity_counts", "select coalesce(severity, 'info') as severity, count(*) as n from logs group by 1", "logs")
_STATS = "select 'total' as dimension, 'all' as value, count(*) as n from logs union all select 'severity', coalesce(severity, 'info'), count(*) from logs group by 2 union all select 'log_source', coalesce(log_source, 'unknown'), count(*) from {t} group by 2 union all select 'event_type', coalesce(event_type, 'unknown'), count(*) from {t} group by 2"
sql("log_stats", _STATS.format(t="logs"), "logs")
sql("log_stats_recent", _STATS.format(t="recent"), "logs", extra=f"recent as (select * from logs {NEWEST} limit 10000)")
_TOP = "select {f}, n from (select {f}, count(*) as n, max(created_at) as latest from {t} where {f} <> '' group by 1 order by n desc, latest desc, {f} limit 10)"
for _name, _field in (("top_attackers", "source_ip"), ("top_targets", "hostname")):
    sql(_name, _TOP.format(f=_field, t="logs"), "logs")
    sql(f"{_name}_recent", _TOP.format(f=_field, t="recent"), "logs", extra=f"recent as (select * from logs {NEWEST} limit 5000)")
_COVER = "select unnest(string_split(mitre_csv, ',')) as technique, count(*) as n from {t} group by 1"
sql("mitre_coverage", _COVER.format(t="alerts"), "alerts")
sql("mitre_coverage_recent", _COVER.format(t="recent"), "alerts", extra=f"recent as (select * from alerts {NEWEST_ALERT} limit 1000)")
_FIG = "select '{m}' as metric, 'all' as value, count(*) as n from {t} where {w}"
_BREAK = "select '{m}' as metric, severity as value, count(*) as n from {t} group by 2"
OPEN_CRITICAL = "severity = 'critical' and not acknowledged"
sql("dashboard_stats", " union all ".join([
    _FIG.format(m="total_logs", t="logs", w="true"), _FIG.format(m="total_alerts", t="alerts", w="true"),
    _FIG.format(m="critical_alerts", t="alerts", w=OPEN_CRITICAL), _FIG.format(m="open_incidents", t="incidents", w="status = 'open'"),
    _FIG.format(m="investigating", t="incidents", w="status = 'investigating'"), _FIG.format(m="contained", t="incidents", w="status = 'contained'"),
    _BREAK.format(m="severity_breakdown", t="logs"), _BREAK.format(m="alert_severity", t="alerts")]), "alerts", "incidents")
sql("alert_summary", " union all ".join([
    _FIG.format(m="unacknowledged", t="alerts", w="not acknowledged"), _FIG.format(m="critical", t="alerts", w="severity = 'critical'"),
    _BREAK.format(m="by_severity", t="alerts")]), "alerts")
sql("report_summary", " union all ".join([
    _FIG.format(m="total_logs", t="logs", w="true"), _FIG.format(m="total_alerts", t="alerts", w="true"),
    _FIG.format(m="critical_alerts", t="alerts", w="severity = 'critical'"), _FIG.format(m="open_incidents", t="incidents", w="status = 'open'"),
    _BREAK.format(m="severity_breakdown", t="alerts")]), "alerts", "incidents")
sql("incident_stats", " union all ".join([f"select '{s}' as status, count(*) as n from incidents where status = '{s}'" for s in C.INCIDENT_STATUSES] + ["select 'total', count(*) from incidents"]), "incidents")
sql("severity_share", "select severity, n, cast(floor((200 * n + t) / (2 * t)) as bigint) as percent from (select severity, n, cast(sum(n) over () as bigint) as t from (select severity, count(*) as n from alerts group by 1))", "alerts")
sql("geo_summary", "select count(*) as total, count(distinct coalesce(country, 'Unknown')) as countries from logs where geo_lat is not null", "logs")
sql("country_counts", "select coalesce(country, 'Unknown') as country, count(*) as n, least(4 + 2 * count(*), 16) as marker from logs where geo_lat is not null group by 1", "logs")
sql("relative_bars", f"select source_ip, n, least(100.0::double, n * 100.0::double / greatest(max(n) over (), 1)) as width from ({_TOP.format(f='source_ip', t='logs')})", "logs")
sql("eps_history", "select epoch_us(make_timestamp(s * 1000000)) as second, strftime(make_timestamp(s * 1000000), '%H:%M:%S') as time, count(b.log_id) as eps from (select unnest(range(e - 60, e)) as s from (select max(epoch_us(created_at)) // 1000000 as e from burst)) left join burst b on epoch_us(b.created_at) // 1000000 = s group by s", "burst")
sql("severity_timeline", "select h * 3600000000 as hour, strftime(make_timestamp(h * 3600000000), '%H:00') as label, " + ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in C.SEVERITIES[:4]) + " from (select unnest(range(e - 23, e + 1)) as h from (select max(epoch_us(created_at)) // 3600000000 as e from logs)) left join logs l on epoch_us(l.created_at) // 3600000000 = h group by h", "logs")

# Detection
RULE_COLUMNS = "log_id, epoch_us(created_at) as created_at, rule_name, severity, title, description, mitre_csv as mitre_techniques, tags_csv as tags"
for _name, _make in STATELESS.items():
    sql(_name, f"select {RULE_COLUMNS} from ({_make('logs')})", "logs")
for _name, (_ctes, _texts) in THRESHOLD.items():
    sql(_name, f"select {RULE_COLUMNS} from ({_texts('fired')})", "burst", extra=_ctes("burst"), recursive=True)


sql("all_alerts", f"select {ALERT_ID} as alert_id, log_id, rule_name, severity, title, description from ({_ALL})", "burst", extra=_CTES, recursive=True)
sql("backfill_alerts", f"select rule_name, severity, count(*) as n from ({_ALL}) group by 1, 2", "burst", extra=_CTES, recursive=True)
sql("user_rule_alerts", f"select rule_name, severity, count(*) as n, count(*) as titles from ({_ALL}) group by 1, 2 union all select 'high_number', 'low', count(*), count(*) from burst where try_cast(substr(hostname, 6) as int) >= 8 having count(*) > 0", "burst", extra=_CTES, recursive=True)
sql("alert_records", f"select {ALERT_COLUMNS.replace('acknowledged,', 'false as acknowledged,', 1)} from alerts", "alerts")

# Behaviour
HOURS = "hours as (select username, date_trunc('hour', created_at) as hour, count(*) as events, min(created_at) as first_seen from logs where username <> '' group by 1, 2)"
RISKS = f"risks as (select username, cast(sum(risk) as bigint) as rs, count(*) as rn, max(risk) as peak_risk from (select username, coalesce(risk_score, 20) as risk, row_number() over (partition by username {NEWEST}) as place from logs where username <> '') where place <= 1000 group by 1)"
PROFILES = f"""{HOURS}, {RISKS}, totals as (select username, cast(sum(events) as bigint) as total_events, count(*) as ah,
  cast(coalesce(sum(case when hour = (select date_trunc('hour', max(created_at)) from logs) then events end), 0) as bigint) as current_hour_events, min(first_seen) as first_seen from hours group by 1),
profiles as (select t.username, cast(floor((200 * total_events + ah) / (2 * ah)) as double) / 100 as avg_hourly_events, current_hour_events,
  cast(floor((200 * rs + rn) / (2 * rn)) as double) / 100 as avg_risk_score, peak_risk, total_events,
  rs > 60 * rn or current_hour_events * ah > 3 * total_events as anomaly_flag, first_seen from totals t join risks r on r.username = t.username)"""
PROFILE_COLUMNS = "username, avg_hourly_events, current_hour_events, avg_risk_score, peak_risk, total_events, anomaly_flag"
TOP_USERS = "(select * from profiles order by avg_risk_score desc, first_seen, username limit 10)"
sql("ueba_hourly", "select username, epoch_us(hour) as hour, events from hours", "logs", extra=HOURS)
sql("ueba_profile", "select u.username, coalesce(avg_hourly_events, 0.0) as avg_hourly_events, coalesce(current_hour_events, 0) as current_hour_events, coalesce(avg_risk_score, 20.0) as avg_risk_score, coalesce(peak_risk, 0) as peak_risk, coalesce(total_events, 0) as total_events, coalesce(anomaly_flag, false) as anomaly_flag from (select distinct concat('user', cast(user_id % 50 as varchar)) as username from events) u left join profiles p on p.username = u.username", "logs", extra=PROFILES)
sql("ueba_profiles", f"select {PROFILE_COLUMNS} from profiles", "logs", extra=PROFILES)
sql("ueba_top_users", f"select {PROFILE_COLUMNS} from {TOP_USERS}", "logs", extra=PROFILES)
sql("ueba_population", f"select count(*) as users, count(*) filter (where anomaly_flag) as anomalous, cast(floor(avg(avg_risk_score) + 0.5) as bigint) as avg_risk from profiles", "logs", extra=PROFILES)
sql("ueba_population_top", f"select count(*) as users, count(*) filter (where anomaly_flag) as anomalous, cast(floor(avg(avg_risk_score) + 0.5) as bigint) as avg_risk from {TOP_USERS}", "logs", extra=PROFILES)
sql("ueba_radar", " union all ".join(f"select username, '{n}' as subject, {e} as a from profiles" for n, e in {
    "Login Freq": "least(100.0::double, current_hour_events * 5.0::double)", "Risk Score": "avg_risk_score", "Peak Risk": "cast(peak_risk as double)",
    "Hourly Vol": "least(100.0::double, avg_hourly_events * 3.0::double)", "Anomaly": "case when anomaly_flag then 80.0::double else 20.0::double end"}.items()), "logs", extra=PROFILES)
sql("entity_risk", "select username as entity, 'user' as type, cast(least(100, floor(avg_risk_score)) as int) as risk_score, avg_hourly_events, current_hour_events, avg_risk_score, peak_risk, total_events, anomaly_flag from profiles union all select distinct hostname, 'host', 50, null, null, null, null, null, cast(null as boolean) from logs", "logs", extra=PROFILES)

# The forest, grown again: samples by places on a circle, all trees level by level, then every distinct point walks down.
def _usual(n):
    return f"case when {n} <= 1 then 0.0::double when {n} = 2 then 1.0::double else 2.0::double * (ln({n} - 1.0::double) + 0.5772156649015329::double) - 2.0::double * ({n} - 1.0::double) / {n} end"


def _draw(what):
    return f"('0x' || substr(md5('42:' || tree || ':' || node || ':{what}'), 1, 8))::bigint"


_SPLIT = f"""case when n <= 1 or depth >= (select deepest from size) or (lo0 = hi0 and lo1 = hi1) then -1
    when lo0 = hi0 then 1 when lo1 = hi1 then 0 else {_draw("f")} % 2 end"""
_LOW, _HIGH = "(case feature when 0 then lo0 else lo1 end)", "(case feature when 0 then hi0 else hi1 end)"
_DRAWN = f"({_LOW} + ({_HIGH} - {_LOW}) * ({_draw('c')} / 4294967296.0::double))"
_CUT = f"(case when {_DRAWN} >= {_HIGH} then {_LOW} else {_DRAWN} end)"
_SPANS = "count(*) over w, min(f0) over w, max(f0) over w, min(f1) over w, max(f1) over w"
FOREST = f"""points as materialized (select log_id, risk_score, anomaly_score, coalesce(risk_score::double, 20.0::double) as f0, coalesce(anomaly_score, 0.1::double) as f1,
    ('0x' || substr(md5('42:' || log_id), 1, 8))::bigint // 2 as place from logs),
drawn as materialized (select tree, log_id, f0, f1 from (
    select *, row_number() over (partition by tree order by (place - tree * (2147483648 // 100) + 2147483648) % 2147483648, log_id) as nth
    from points, range(100) r(tree)) where nth <= 256),
size as materialized (select max(n) as n, ceil(log2(greatest(max(n), 2)::double)) as deepest, {_usual("max(n)")} as usual from (select tree, count(*) as n from drawn group by tree)),
grown(tree, node, depth, f0, f1, n, lo0, hi0, lo1, hi1) as (
  select tree, node, depth, f0, f1, {_SPANS} from (select tree, 1::bigint as node, 0 as depth, f0, f1 from drawn) window w as (partition by tree, node)
  union all
  select tree, node, depth, f0, f1, {_SPANS} from (
    select tree, 2 * node + case when (case feature when 0 then f0 else f1 end) <= {_CUT} then 0 else 1 end as node, depth + 1 as depth, f0, f1
    from (select *, {_SPLIT} as feature from grown) where feature >= 0) window w as (partition by tree, node)),
nodes as materialized (select *, {_CUT} as threshold, depth + {_usual("n")} as path
  from (select distinct tree, node, depth, n, lo0, hi0, lo1, hi1, {_SPLIT} as feature from grown)),
walk(f0, f1, tree, node) as (
  select f0, f1, tree, 1::bigint from (select distinct f0, f1 from points), range(100) r(tree)
  union all
  select w.f0, w.f1, w.tree, 2 * w.node + case when (case feature when 0 then w.f0 else w.f1 end) <= threshold then 0 else 1 end
  from walk w join nodes d on d.tree = w.tree and d.node = w.node where feature >= 0),
raws as materialized (select f0, f1, -pow(2.0::double, -sum(path) / 100.0::double / (select usual from size)) as raw
  from walk w join nodes d on d.tree = w.tree and d.node = w.node where feature < 0 group by f0, f1),
cutoff as (select raw as least_usual from (select raw, row_number() over (order by raw) as nth, count(*) over () as m
  from (select distinct log_id, f0, f1 from drawn) join raws using (f0, f1)) where nth = ceil(0.05::double * m)),
scored as (select log_id, risk_score, anomaly_score, round(greatest(0.0::double, least(1.0::double, 0.5::double - (raw - least_usual))), 6) as forest_score
  from points join raws using (f0, f1), cutoff)"""
sql("iforest_train", "select tree::int as tree, count(*) as nodes, round(max(case when feature < 0 then path else 0.0 end), 6) as longest_path from nodes group by tree", "logs", extra=FOREST, recursive=True)
sql("anomaly_scores", "select *, forest_score >= 0.6 as is_anomalous from scored", "logs", extra=FOREST, recursive=True)
sql("anomalous_logs", "select *, true as is_anomalous from scored where forest_score >= 0.6", "logs", extra=FOREST, recursive=True)
sql("log_risk", "select *, forest_score >= 0.6 as is_anomalous, cast(least(100, coalesce(risk_score, 20) + floor(forest_score * 40)) as int) as log_risk from scored", "logs", extra=FOREST, recursive=True)
sql("risk_bands", "select case when risk_score >= 80 then 'critical' when risk_score >= 60 then 'high' when risk_score >= 40 then 'medium' when risk_score >= 20 then 'low' else 'info' end as risk_band, case when risk_score >= 75 then 'critical' when risk_score >= 50 then 'medium' when risk_score >= 25 then 'low' else 'clean' end as indicator_band, count(*) as n from logs group by 1, 2", "logs")

# Table changes
sql("update_one", f"select {INCIDENT_COLUMNS.replace('status, assigned_to', 'case when hit then {0} else status end as status, case when hit then {1} else assigned_to end as assigned_to').format(chr(39) + 'investigating' + chr(39), chr(39) + 'lead' + chr(39))} from (select *, incident_id = (select arg_min(incident_id, row(created_at, incident_id)) from incidents where status = 'open' and severity = 'critical') as hit from incidents)", "incidents")
OPEN_HIGH = "status = 'open' and severity in ('critical', 'high')"
sql("update_many", f"select {INCIDENT_COLUMNS.replace('assigned_to', 'case when {w} then {v} else assigned_to end as assigned_to').format(w=OPEN_HIGH, v=chr(39) + 'lead' + chr(39))} from incidents", "incidents")
sql("update_count", f"select count(*) as n from incidents where {OPEN_HIGH}", "incidents")
sql("delete_matching", f"select {INCIDENT_COLUMNS} from incidents where not (status = 'resolved' and created_at <= timestamp '1996-01-01')", "incidents")
sql("alerts_acknowledged", """select a.alert_id, a.log_id, a.rule_name, a.acknowledged or c.actor is not null as acknowledged, c.actor as acknowledged_by, c.notes as ack_notes
  from alerts a left join (select alert_id, arg_max(actor, row(ts, cmd_id)) as actor, arg_max(notes, row(ts, cmd_id)) as notes from alert_cmds where cmd = 'acknowledge' group by 1) c on c.alert_id = a.alert_id""", "alerts", "alert_cmds")
sql("escalated_incidents", f"""select {ESCALATION} as incident_id, epoch_us(c.ts) as created_at, concat('[Escalated] ', a.title) as title, a.description, a.severity, 'open' as status, a.alert_id as alert_ids,
  c.actor as assigned_to, c.actor as created_by, a.mitre_csv as mitre_techniques, a.source_ip, a.hostname, a.tags_csv as tags
  from alerts a join alert_cmds c on c.alert_id = a.alert_id and c.cmd = 'escalate'""", "alerts", "alert_cmds")
sql("escalation_timeline", f"select {ESCALATION} as incident_id, epoch_us(c.ts) as ts, 'incident_created' as action, c.actor, concat('Escalated from alert ', a.alert_id) as note from alerts a join alert_cmds c on c.alert_id = a.alert_id and c.cmd = 'escalate'", "alerts", "alert_cmds")
sql("alerts_linked", f"""select a.alert_id, a.log_id, a.rule_name, case when c.cmd_id is not null then {ESCALATION} end as incident_id
  from alerts a left join (select alert_id, arg_max(cmd_id, row(ts, cmd_id)) as cmd_id from alert_cmds where cmd = 'escalate' group by 1) c on c.alert_id = a.alert_id""", "alerts", "alert_cmds")
sql("incidents_created", f"""select {_id("'incident'", "cast(request_id as varchar)")} as incident_id, epoch_us(ts) as created_at, title, description, coalesce(severity, 'medium') as severity, 'open' as status,
  case when coalesce(assigned_to, '') <> '' then assigned_to else actor end as assigned_to, actor as created_by, 'manual' as tags, coalesce(source_ip, '') as source_ip, coalesce(hostname, '') as hostname, mitre_csv as mitre_techniques, '' as alert_ids from requests""", "requests")
sql("creation_timeline", f"""select {_id("'incident'", "cast(request_id as varchar)")} as incident_id, epoch_us(ts) as ts, 'incident_created' as action, actor, 'Incident created manually' as note from requests""", "requests")
sql("iocs_created", f"""select {_id("'indicator'", "cast(request_id as varchar)")} as ioc_id, epoch_us(ts) as created_at, ioc_type, value, coalesce(threat_type, 'unknown') as threat_type, coalesce(confidence, 50) as confidence, 'manual' as tags,
  coalesce(notes, '') as notes, coalesce(source, 'manual') as source, true as active, actor as created_by, 0 as hit_count from requests""", "requests")
sql("iocs_remaining", "select * from indicators where ioc_id not in (select user_id * 2 from events where event_type = 'error')", "indicators")

# Case workflow: one recursion step per command of an incident
LEGAL_PAIRS = _values([(a, b) for a, steps in C.LEGAL_STEPS.items() for b in steps], "l", "a, b")
FOLD = f"""numbered as (select c.*, row_number() over (partition by incident_id order by ts, cmd_id) as place,
    (cmd = 'transition' or (cmd = 'update' and new_status is not null)) as moves from commands c where incident_id in (select incident_id from incidents)),
  legal as (select * from {LEGAL_PAIRS}),
  fold(incident_id, place, from_status, to_status, accepted) as (
    select incident_id, cast(0 as bigint), status, status, true from incidents
    union all
    select n.incident_id, n.place, f.to_status, case when n.moves and l.b is not null then n.new_status else f.to_status end, not n.moves or l.b is not null
    from fold f join numbered n on n.incident_id = f.incident_id and n.place = f.place + 1
    left join legal l on l.a = f.to_status and l.b = n.new_status),
  decided as (select n.*, f.from_status, f.to_status, f.accepted from numbered n join fold f on f.incident_id = n.incident_id and f.place = n.place)"""


def _last(column, when):
    return f"arg_max({column}, row(ts, cmd_id)) filter (where {when} and {column} is not null)"


sql("incident_transitions", "select incident_id, epoch_us(ts) as ts, 'status_change' as action, actor, concat('Status changed: ', from_status, ' → ', new_status) as note, cmd_id from decided where accepted and cmd = 'transition'", "incidents", "commands", extra=FOLD, recursive=True)
sql("incident_notes", "select incident_id, epoch_us(ts) as ts, actor as author, content, cmd_id from commands where cmd = 'note' and incident_id in (select incident_id from incidents)", "incidents", "commands")
sql("commands_rejected", """select cmd_id, incident_id, cmd, concat('Cannot transition from ', from_status, ' to ', coalesce(new_status, 'nothing')) as reason from decided where not accepted
  union all select cmd_id, incident_id, cmd, 'Incident not found' from commands where incident_id not in (select incident_id from incidents)""", "incidents", "commands", extra=FOLD, recursive=True)
sql("incidents_updated", f"""select i.incident_id, i.title, coalesce(s, i.status) as status, coalesce(v, i.severity) as severity, coalesce(w, i.assigned_to) as assigned_to, epoch_us(updated_at) as updated_at, updated_by
  from incidents i left join (select incident_id, {_last('new_status', 'true')} as s, {_last('new_severity', "cmd = 'update'")} as v, {_last('new_assignee', "cmd = 'update'")} as w,
    max(ts) as updated_at, {_last('actor', "cmd = 'update'")} as updated_by from decided where accepted and cmd <> 'note' group by 1) c on c.incident_id = i.incident_id""", "incidents", "commands", extra=FOLD, recursive=True)

# Scalar functions and live counters
_SIZE = "cast(floor(o_totalprice * o_custkey * 40) as bigint)"
ORACLE["format_bytes"] = f"select o_orderkey, case when s = 0 or s is null then '0 B' " + " ".join(
    f"when s >= {10**p} then concat(cast(cast(floor((s * 10 + {10**p // 2}) / {10**p}.0::double) as bigint) // 10 as varchar), '.', cast(cast(floor((s * 10 + {10**p // 2}) / {10**p}.0::double) as bigint) % 10 as varchar), ' {u}')"
    for p, u in ((12, "TB"), (9, "GB"), (6, "MB"), (3, "KB"), (0, "B"))) + f" end as size from (select o_orderkey, {_SIZE} as s from orders)"
sql("time_ago", "select log_id, case when s < 60 then concat(s, 's ago') when s < 3600 then concat(s // 60, 'm ago') when s < 86400 then concat(s // 3600, 'h ago') else concat(s // 86400, 'd ago') end as age from (select log_id, (max(epoch_us(created_at)) over () - epoch_us(created_at)) // 1000000 as s from logs)", "logs")
sql("severity_order", "select log_id, cast(case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end as int) as rank from logs", "logs")
sql("notify_alerts", "select alert_id, severity, title from alerts where severity in ('critical', 'high')", "alerts")
sql("unread_alerts", "select count(*) as unread from alerts where created_at > timestamp '2024-01-20'", "alerts")

# Streaming: windows still open at the end of the stream are not written
sql("stream_eps", "select s * 1000000 as second, count(*) as eps from (select epoch_us(created_at) // 1000000 as s, max(epoch_us(created_at)) over () as newest from burst) where (s + 1) * 1000000 <= (newest // 1000 - 10000) * 1000 group by 1", "burst")
sql("stream_user_hours", "select username, h * 3600000000 as hour, count(*) as events from (select username, epoch_us(created_at) // 3600000000 as h, max(epoch_us(created_at)) over () as newest from logs where username <> '') where (h + 1) * 3600000000 <= (newest // 1000 - 600000) * 1000 group by 1, 2", "logs")
ORACLE["stream_alerts"] = ORACLE["all_alerts"]
sql("stream_messages", f"select 'log' as type, severity, count(*) as n from burst group by 2 union all select 'alert', severity, count(*) from ({_ALL}) group by 2", "burst", extra=_CTES, recursive=True)
sql("stream_risk_history", "select username, rs as risk_sum, rn as risk_n, peak_risk from risks", "logs", extra=RISKS)
sql("stream_unread", "select count(*) as unread from alerts where rule_name not in ('brute_force', 'port_scan', 'beaconing') and created_at > (select max(created_at) from burst where log_id % 1000 = 999)", "burst", "alerts")
sql("stream_buffer", f"select log_id, epoch_us(created_at) as created_at, severity, message from (select * from logs {NEWEST} limit 500)", "logs")
