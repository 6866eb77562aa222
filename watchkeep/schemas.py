"""Table schemas.  Fields a source does not carry stay null."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

_S, _I, _L, _D, _B, _T = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType()
_LIST = ArrayType(StringType())


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


LOGS = _struct(
    log_id=_S, created_at=_T, log_source=_S, event_id=_I, event_type=_S, severity=_S, hostname=_S, username=_S,
    source_ip=_S, process=_S, facility=_S, dest_ip=_S, protocol=_S, dest_port=_I, action=_S, signature=_S,
    http_method=_S, url_path=_S, status_code=_I, bytes_out=_L, message=_S, raw_log=_S, mitre_techniques=_LIST,
    country=_S, geo_lat=_D, geo_lon=_D, anomaly_score=_D, risk_score=_I, attack_campaign=_S, powershell_payload=_S,
)
ALERTS = _struct(
    alert_id=_S, created_at=_T, title=_S, description=_S, severity=_S, rule_name=_S, source_ip=_S, hostname=_S,
    username=_S, log_id=_S, mitre_techniques=_LIST, tags=_LIST, acknowledged=_B, acknowledged_by=_S, incident_id=_S,
    raw_log_snippet=_S, ack_notes=_S,
)
# Notes and timeline entries are tables of their own: one case may have very many.
INCIDENTS = _struct(
    incident_id=_S, created_at=_T, title=_S, description=_S, severity=_S, status=_S, assigned_to=_S, created_by=_S,
    tags=_LIST, source_ip=_S, hostname=_S, mitre_techniques=_LIST, alert_ids=_LIST, updated_at=_T, updated_by=_S,
)
TIMELINE = _struct(incident_id=_S, ts=_T, action=_S, actor=_S, note=_S)
NOTES = _struct(incident_id=_S, ts=_T, author=_S, content=_S)
INDICATORS = _struct(
    ioc_id=_S, created_at=_T, ioc_type=_S, value=_S, threat_type=_S, confidence=_I, tags=_LIST, notes=_S, source=_S,
    active=_B, created_by=_S, hit_count=_I,
)
EVENTS_INPUT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
