"""Security tables derived from the given parquet tables, for the checks.

One SQL text per table serves Spark and DuckDB; only the placeholders differ.
``logs`` spreads events over 30 days; ``burst`` squeezes the same events into
20 minutes, so that the second-scale window rules have something to find.
Every table reads all rows of the table it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchkeep import constants as C
from watchkeep.session import tune


def _values(rows) -> str:
    """Rows as a list of SQL values."""
    cell = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# Look-up tables rendered from the library's constants, numbered in their order.
_HOST_ROWS = _values(
    (i, event, title.lower().replace(" ", "_"), severity, ",".join(techniques))
    for i, (event, (title, severity, techniques)) in enumerate(C.HOST_EVENTS.items()))
_SIGNATURE_ROWS = _values(
    (i, name, severity, ",".join(techniques)) for i, (name, (severity, techniques)) in enumerate(C.SIGNATURES.items()))
_COUNTRIES = ["Norway", "Chile", "Kenya", "Japan", "Canada", "Portugal"]

# Shares of the sources in percent: 28 host events, 22 syslog, 24 firewall, 11 intrusion, 7 web, 4 flows, 4 sign-ins.
LOGS = """
with b as (
  select event_id as log_id, {us} as us, user_id as u, value as v, cast({k} as int) as k,
         cast((event_id * 53 + user_id * 29) % 100 as int) as sel
  from events),
s as (
  select b.*, case when sel < 24 then 'firewall' when sel < 52 then 'windows_event' when sel < 74 then 'linux_syslog'
    when sel < 85 then 'ids_ips' when sel < 92 then 'web_server' when sel < 96 then 'auth_log' else 'netflow' end as log_source from b),
win as (select * from (values """ + _HOST_ROWS + """) as t(wi, w_id, w_type, w_sev, w_mitre)),
ids as (select * from (values """ + _SIGNATURE_ROWS + """) as t(ii, i_sig, i_sev, i_mitre)),
f as (
  select s.*, w_id, w_type, w_sev, w_mitre, i_sig, i_sev, i_mitre,
    case when log_source = 'firewall' then (case when sel < 16 then 'DENY' when sel < 18 then 'DROP' else 'ALLOW' end) end as action,
    case when log_source = 'web_server' then (case k % 6 when 0 then 200 when 1 then 204 when 2 then 302 when 3 then 403 when 4 then 500 else 503 end) end as status_code,
    case when log_source = 'windows_event' then (case k % 9 when 0 then 'powershell.exe' when 1 then 'notepad.exe' when 2 then 'Mimikatz.exe'
       when 3 then 'lsass.exe' else 'taskhostw.exe' end) end as process,
    case when log_source in ('windows_event','linux_syslog','auth_log') and u % 23 <> 0 then concat('user', cast(u % 40 as varchar(20))) end as username,
    case when log_source = 'netflow' then '192.168.7.20' else concat('203.0.113.', cast(case when log_source = 'firewall' then u % 4 else u % 20 end as varchar(20))) end as source_ip,
    case log_source when 'firewall' then concat('EDGE-', cast(u % 2 as varchar(20))) when 'ids_ips' then 'TAP-3' when 'web_server' then concat('PORTAL-', cast(u % 3 as varchar(20)))
       when 'auth_log' then 'GATE-1' else concat('HOST-', cast(u % 12 as varchar(20))) end as hostname,
    case when log_source = 'netflow' then concat('198.51.100.', cast(u % 4 as varchar(20)))
         when log_source in ('firewall','ids_ips') then (case u % 3 when 0 then concat('198.51.100.', cast(u % 2 as varchar(20))) when 1 then '10.0.0.9' else concat('192.168.1.', cast(u % 20 as varchar(20))) end) end as dest_ip,
    case when log_source = 'firewall' then cast(k * 10 + log_id % 10 as int) when log_source = 'netflow' then 8443 end as dest_port,
    case when log_source = 'netflow' then cast(floor(v * 250000.0) as bigint) end as bytes_out
  from s left join win on wi = k % 12 and log_source = 'windows_event' left join ids on ii = k % 10 and log_source = 'ids_ips')
select log_id, {mk} as created_at, log_source, w_id as event_id,
  case log_source when 'windows_event' then w_type when 'linux_syslog' then (case when k < 45 then 'ssh_failed_login' else 'syslog_event' end)
    when 'firewall' then concat('firewall_', lower(action)) when 'ids_ips' then (case when k % 10 = 4 then 'reverse_shell' else 'ids_alert' end)
    when 'web_server' then (case when status_code = 503 then 'http_flood' else 'http_request' end)
    when 'netflow' then (case when k % 5 = 0 then 'data_exfiltration' else 'flow' end) else (case when k % 2 = 0 then 'impossible_travel' else 'vpn_logon' end) end as event_type,
  case log_source when 'windows_event' then w_sev when 'ids_ips' then i_sev when 'firewall' then (case when action = 'ALLOW' then 'low' when k % 3 = 0 then 'high' else 'medium' end)
    when 'web_server' then (case when status_code < 400 then 'info' when status_code < 500 then 'medium' else 'high' end)
    when 'linux_syslog' then (case when k < 50 then 'low' when k < 75 then 'info' else 'medium' end) when 'netflow' then 'critical' else 'high' end as severity,
  hostname, username, source_ip, dest_ip, dest_port, action, process, i_sig as signature, status_code, bytes_out,
  case log_source when 'windows_event' then concat(w_type, ' at ', hostname, ' by ', coalesce(username, 'nobody'), case k % 32 when 0 then ', added to Domain Admins' when 11 then ', PowerShell -NoP session' else '' end)
    when 'linux_syslog' then (case when k < 55 then concat('Failed password for ', coalesce(username, 'root'), ', peer ', source_ip) else concat('cron job ', cast(k as varchar(20)), ' done') end)
    when 'firewall' then concat(lower(action), ' tcp to ', dest_ip, ' port ', cast(dest_port as varchar(20)))
    when 'ids_ips' then concat('matched ', i_sig, ' towards ', dest_ip)
    when 'web_server' then concat('Web answer ', cast(status_code as varchar(20)), ' to ', source_ip)
    when 'netflow' then concat(case when k % 7 = 1 then 'exfil suspected: ' else '' end, cast(bytes_out as varchar(20)), ' bytes to ', dest_ip) else concat('sign-in of ', coalesce(username, 'nobody'), ' over ', source_ip) end as message,
  concat('host=', hostname, ' peer=', source_ip, case when process = 'powershell.exe' and k % 18 = 0 then ' run: powershell -Enc JAB IEX(New-Object Net.WebClient)' else '' end) as raw_log,
  case when process = 'powershell.exe' and k % 36 = 9 then 'powershell.exe -NoP -W Hidden' end as powershell_payload,
  coalesce(w_mitre, i_mitre, case when action = 'ALLOW' then 'T1071' when log_source = 'netflow' then 'T1041,T1048' else '' end) as mitre_csv,
  case when log_id % 3 <> 0 then (case k % 6 """ + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_COUNTRIES)) + """ end) end as country,
  case when log_id % 3 <> 0 then 10.0e0 + k / 4.0e0 end as geo_lat,
  case when log_id % 3 <> 0 then 20.0e0 + k / 2.0e0 end as geo_lon,
  cast(case when log_id % 61 = 7 then 94 + k % 7 when log_source = 'ids_ips' then 30 + k % 50 when log_source = 'windows_event' then 10 + (u * 7 + k) % 70 else 5 + k % 40 end as int) as risk_score,
  case when log_id % 61 = 7 then 0.9e0 + (k % 10) / 100.0e0 when log_source = 'ids_ips' then 0.2e0 + (k % 50) / 100.0e0 else k / 250.0e0 end as anomaly_score
from f
"""

INDICATORS = """
select s_suppkey as ioc_id, case s_suppkey % 4 when 0 then 'hash' when 1 then 'domain' else 'ip' end as ioc_type,
  case s_suppkey % 4 when 0 then md5(s_name) when 1 then concat('bad', cast(s_suppkey % 9 as varchar(20)), '.example') else concat('203.0.113.', cast(s_suppkey % 30 as varchar(20))) end as value,
  case s_suppkey % 3 when 0 then 'malware' when 1 then 'c2' else 'scanner' end as threat_type,
  cast((s_suppkey * 13) % 101 as int) as confidence, s_suppkey % 5 <> 0 as active from supplier
"""

INCIDENTS = """
select o_orderkey as incident_id, {ots} as created_at, concat('Case ', cast(o_orderkey as varchar(20))) as title,
  concat('Reported by customer ', cast(o_custkey as varchar(20))) as description,
  case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as severity,
  case o_orderstatus when 'F' then 'resolved' when 'P' then 'investigating' else 'open' end as status,
  concat('analyst', cast(o_custkey % 5 as varchar(20))) as assigned_to,
  concat('203.0.113.', cast(o_custkey % 30 as varchar(20))) as source_ip,
  concat('HOST-', cast(o_custkey % 12 as varchar(20))) as hostname,
  case o_orderkey % 4 when 0 then 'T1078' when 1 then 'T1041,T1048' when 2 then 'T1059' else '' end as mitre_csv
from orders
"""

# One command per event: a tenth goes to one busy case, a tenth names cases of
# which about half do not exist, the rest come eight in a row to one case.
COMMANDS = """
select event_id as cmd_id, {ets} as ts,
  case when event_id % 10 = 3 then 1 when event_id % 10 = 7 then event_id * 3 else cast(floor(event_id / 8.0e0) as bigint) end as incident_id,
  concat('analyst', cast(user_id % 5 as varchar(20))) as actor,
  case event_type when 'view' then 'note' when 'signup' then 'update' else 'transition' end as cmd,
  case when event_type = 'view' then null when event_type = 'signup' and cast({k} as int) % 6 = 5 then null
    else (case cast({k} as int) % 5 when 0 then 'open' when 1 then 'investigating' when 2 then 'contained' when 3 then 'resolved' else 'closed' end) end as new_status,
  case when event_type = 'signup' and cast({k} as int) % 3 = 0 then 'critical' end as new_severity,
  case when event_type = 'signup' and cast({k} as int) % 2 = 0 then concat('analyst', cast(user_id % 7 as varchar(20))) end as new_assignee,
  case when event_type = 'view' then concat('Seen value ', cast(cast({k} as int) as varchar(20))) end as content
from events
"""

# One command per event on the alert of an even-numbered log; the rule part of
# the name is a guess, so most names match no alert.
ALERT_COMMANDS = """
select event_id as cmd_id, {ets} as ts, event_id - event_id % 2 as log_id,
  case cast({k} as int) % 4 when 0 then 'malware_indicators' when 1 then 'data_exfiltration' when 2 then 'suspicious_powershell' else 'privilege_escalation' end as rule_name,
  concat('analyst', cast(user_id % 5 as varchar(20))) as actor,
  case when event_type in ('view', 'click', 'error') then 'acknowledge' else 'escalate' end as cmd,
  concat('note ', cast(cast({k} as int) as varchar(20))) as notes
from events
"""

# One request per event for a new incident, and one for a new indicator.
REQUESTS = """
select event_id as request_id, {ets} as ts, concat('analyst', cast(user_id % 5 as varchar(20))) as actor,
  concat('Manual case ', cast(event_id as varchar(20))) as title, concat('Value ', cast(cast({k} as int) as varchar(20))) as description,
  case event_type when 'view' then null when 'error' then 'critical' else 'low' end as severity,
  case when user_id % 3 = 0 then 'lead' when user_id % 3 = 1 then '' end as assigned_to,
  case when user_id % 4 = 0 then null else concat('203.0.113.', cast(user_id % 20 as varchar(20))) end as source_ip,
  case when user_id % 2 = 0 then concat('HOST-', cast(user_id % 12 as varchar(20))) end as hostname,
  case event_type when 'click' then 'domain' when 'view' then 'hash' when 'error' then 'url' else 'ip' end as ioc_type,
  concat('203.0.113.', cast(user_id % 90 as varchar(20))) as value,
  case when user_id % 3 = 0 then 'phishing' end as threat_type,
  case when user_id % 5 <> 0 then cast({k} as int) end as confidence,
  case when user_id % 7 = 0 then 'seen before' end as notes,
  case when user_id % 11 = 0 then 'partner' end as source,
  case when user_id % 2 = 0 then 'T1078' else '' end as mitre_csv
from events
"""

# Web requests: one per page, with the page's path or a sensitive one.
WEB = """
select page_id as log_id, case page_id % 7 when 0 then 200 when 1 then 201 when 2 then 302 when 3 then 404 when 4 then 500 when 5 then 503 end as status_code,
  case page_id % 9 when 0 then '/.env' when 1 then '/api/admin/reset' when 2 then concat('/admin/', cast(page_id as varchar(20))) when 3 then '/admin'
    else substr(url, 9 + instr(substr(url, 9), '/') - 1) end as url_path
from pages
"""

_START = 1704067200000000  # 2024-01-01 in microseconds

_SPARK = {
    "{us}": "unix_micros(cast(ts as timestamp))",
    "{k}": "get_json_object(props,'$.k')",
    "{ots}": "cast(o_orderdate as timestamp)",
    "{ets}": "cast(ts as timestamp)",
}
_DUCKDB = {
    "{us}": "epoch_us(ts)",
    "{k}": "json_extract_string(props,'$.k')",
    "{ots}": "o_orderdate",
    "{ets}": "ts",
}
_SQUEEZED = f"{_START} + cast(floor((us - {_START}) / 2160.0e0) as bigint)"
_MAKE_TIME = {"spark": "timestamp_micros", "duckdb": "make_timestamp"}


def _render(text: str, engine: str, squeeze: bool = False) -> str:
    for mark, value in (_SPARK if engine == "spark" else _DUCKDB).items():
        text = text.replace(mark, value)
    time = f"{_MAKE_TIME[engine]}({_SQUEEZED if squeeze else 'us'})"
    return text.replace("{mk}", time).strip()


def duckdb_sql(name: str) -> str:
    """The DuckDB statement of one derived table."""
    text, squeeze = _TABLES[name][1:]
    return _render(text, "duckdb", squeeze)


_TABLES = {
    "logs": ("events", LOGS, False),
    "burst": ("events", LOGS, True),
    "indicators": ("supplier", INDICATORS, False),
    "incidents": ("orders", INCIDENTS, False),
    "commands": ("events", COMMANDS, False),
    "alert_commands": ("events", ALERT_COMMANDS, False),
    "requests": ("events", REQUESTS, False),
    "web": ("pages", WEB, False),
}


def derive(source: DataFrame, name: str) -> DataFrame:
    """Derived table ``name`` over ``source``, batch or stream."""
    base, text, squeeze = _TABLES[name]
    marked = _render(text, "spark", squeeze).replace(f"from {base}", "from {source}")
    return source.sparkSession.sql(marked, source=source)


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return derive(tune(spark).read.parquet(f"{folder}/{_TABLES[name][0]}.parquet"), name)
