"""The detection rules, declared as predicates and thresholds.

A rule states when a log qualifies and what its alert says; how rules are run
is the business of ``watchkeep.plans.detection``.  User rules are made the same
way and passed next to, or instead of, these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from watchkeep import constants as C
from watchkeep.functions.text import any_phrase, named, phrases_found, text
from watchkeep.operators.thresholds import Threshold

# Columns of a qualifying log that a threshold rule may use in its texts; a
# rule adds others through ``carry``.
CARRIED = ["log_id", "created_at", "source_ip", "hostname", "username", "dest_ip", "raw_log"]


def readable(logs: DataFrame) -> DataFrame:
    """Logs with the lower-cased texts that rules search, each computed once.

    Rules may use these four columns next to the columns of the log.
    """
    return logs.withColumns(
        {
            "message_lower": F.lower(text("message")),
            "signature_lower": F.lower(text("signature")),
            "process_lower": F.lower(text("process")),
            "command_lower": F.lower(F.concat(text("raw_log"), text("message"), text("powershell_payload"))),
        }
    )


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    techniques: list[str]
    tags: list[str]
    when: Column
    title: Column
    description: Column
    # Threshold rules only:
    threshold: Threshold | None = None
    key: Column | None = None
    distinct_value: Column | None = None
    carry: tuple[str, ...] = field(default=())


def _sentence(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _composite(*parts: Column) -> Column:
    """One text key from several; lengths keep different keys different."""
    return F.concat_ws("|", *[F.length(p) for p in parts[:-1]], *parts)


def brute_force() -> Rule:
    source = named("source_ip")
    return Rule(
        name="brute_force",
        severity="high",
        techniques=["T1110.001", "T1078"],
        tags=["brute_force", "authentication", "lateral_movement"],
        when=F.col("event_type").isin(C.FAILED_LOGON_TYPES)
        | (F.col("event_id") == C.FAILED_LOGON_ID)
        | F.col("message").contains(C.FAILED_LOGON_TEXT),
        title=_sentence("Brute Force Attack Detected from ", source),
        description=_sentence(
            f"{C.BRUTE_FORCE_COUNT} failed login attempts from ", source,
            f" within {C.BRUTE_FORCE_SECONDS}s on host ", named("hostname"),
        ),
        threshold=Threshold(C.BRUTE_FORCE_COUNT, C.BRUTE_FORCE_SECONDS),
        key=source,
    )


def port_scan() -> Rule:
    source = named("source_ip")
    return Rule(
        name="port_scan",
        severity="medium",
        techniques=["T1046"],
        tags=["port_scan", "reconnaissance", "network"],
        when=(F.col("log_source") == "firewall") & F.col("action").isin(C.BLOCKED_ACTIONS) & (F.col("dest_port") != 0),
        title=_sentence("Port Scan Detected from ", source),
        description=_sentence(
            "Source ", source, f" scanned {C.PORT_SCAN_PORTS} unique ports on ", named("dest_ip"),
            f" within {C.PORT_SCAN_SECONDS}s",
        ),
        threshold=Threshold(C.PORT_SCAN_PORTS, C.PORT_SCAN_SECONDS, distinct=True),
        key=source,
        distinct_value=F.col("dest_port").cast("string"),
    )


def privilege_escalation() -> Rule:
    return Rule(
        name="privilege_escalation",
        severity="critical",
        techniques=["T1078.002", "T1098", "T1134"],
        tags=["privilege_escalation", "persistence", "credential_access"],
        when=F.col("event_id").isin(C.PRIVILEGE_IDS)
        | (F.col("event_type") == "privilege_escalation")
        | any_phrase("message_lower", C.PRIVILEGE_PHRASES),
        title=_sentence("Privilege Escalation on ", named("hostname")),
        description=_sentence(
            "User ", named("username"), " performed a privilege escalation action (EventID ",
            F.coalesce(F.col("event_id").cast("string"), F.lit("None")), ") on ", named("hostname"),
        ),
    )


def suspicious_powershell() -> Rule:
    gate = (
        F.col("process_lower").isin(C.POWERSHELL_PROCESSES)
        | F.col("message_lower").contains("powershell")
        | (text("event_type") == "suspicious_powershell")
    )
    return Rule(
        name="suspicious_powershell",
        severity="critical",
        techniques=["T1059.001", "T1027", "T1140"],
        tags=["powershell", "execution", "defense_evasion"],
        when=gate & any_phrase("command_lower", C.POWERSHELL_PATTERNS),
        title=_sentence("Suspicious PowerShell Activity on ", named("hostname")),
        description=_sentence(
            "Suspicious PowerShell patterns detected: [",
            F.concat_ws(", ", phrases_found("command_lower", C.POWERSHELL_PATTERNS, at_most=3)),
            "] by ", named("username"), " on ", named("hostname"),
        ),
    )


def impossible_travel() -> Rule:
    return Rule(
        name="impossible_travel",
        severity="high",
        techniques=["T1078", "T1534"],
        tags=["impossible_travel", "account_compromise", "anomaly"],
        when=F.col("event_type") == "impossible_travel",
        title=_sentence("Impossible Travel Detected for ", named("username")),
        description=named("message", "Impossible travel login detected"),
    )


def data_exfiltration() -> Rule:
    megabytes = F.expr("coalesce(bytes_out, 0L) div 1000000")
    return Rule(
        name="data_exfiltration",
        severity="critical",
        techniques=["T1041", "T1048", "T1030"],
        tags=["data_exfiltration", "exfiltration", "insider_threat"],
        when=(F.col("event_type") == "data_exfiltration")
        | (F.col("bytes_out") >= C.EXFILTRATION_BYTES)
        | F.col("message_lower").contains("exfil"),
        title=_sentence("Data Exfiltration Detected from ", named("hostname")),
        description=_sentence(
            "Large outbound data transfer detected: ", megabytes.cast("string"), "MB from ",
            named("hostname"), " to ", named("dest_ip"),
        ),
    )


def malware_indicators() -> Rule:
    process, signature = F.col("process_lower"), F.col("signature_lower")
    known = process.isin(C.MALWARE_PROCESSES)
    indicator = F.when(known, process).when(signature != "", F.substring(signature, 1, 40)).otherwise("malware pattern")
    return Rule(
        name="malware_indicators",
        severity="critical",
        techniques=["T1059", "T1055", "T1036", "T1071"],
        tags=["malware", "execution", "c2", "edr"],
        when=known
        | any_phrase("message_lower", C.MALWARE_PHRASES)
        | any_phrase("signature_lower", C.MALWARE_PHRASES)
        | (F.col("event_type") == "malware_execution"),
        title=_sentence("Malware Indicator Detected on ", named("hostname")),
        description=_sentence(
            "Known malware indicator [", indicator, "] detected on ", named("hostname"), " by user ", named("username"),
        ),
    )


def beaconing() -> Rule:
    host = named("hostname")
    target = F.when(text("dest_ip") != "", F.col("dest_ip")).otherwise(text("source_ip"))
    inside = F.lit(False)
    for prefix in C.INTERNAL_PREFIXES:
        inside = inside | target.startswith(prefix)
    return Rule(
        name="beaconing",
        severity="high",
        techniques=["T1071.001", "T1102", "T1008"],
        tags=["c2", "beaconing", "command_control", "persistence"],
        when=F.col("log_source").isin(C.BEACON_SOURCES)
        & (F.col("action").isNull() | (F.col("action") == "ALLOW"))
        & (target != "")
        & ~inside,
        title=_sentence("C2 Beaconing Detected: ", host, " → ", target),
        description=_sentence(
            host, f" made {C.BEACON_COUNT} periodic connections to ", target,
            f" within {C.BEACON_SECONDS}s — possible C2 beacon",
        ),
        threshold=Threshold(C.BEACON_COUNT, C.BEACON_SECONDS),
        key=_composite(host, target),
    )


def default_rules() -> list[Rule]:
    """All rules, in the order in which a log is tested."""
    return [
        brute_force(), port_scan(), privilege_escalation(), suspicious_powershell(),
        impossible_travel(), data_exfiltration(), malware_indicators(), beaconing(),
    ]
