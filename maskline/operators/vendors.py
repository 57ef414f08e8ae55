"""Vendor layouts: what fields a line of a known source has, as Column expressions.

A source is its own wire form (CSV with fixed columns, key=value, a pattern)
followed by canonical names for what it found.  Values stay as written: a
dash is kept, numbers are not converted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.operators import layouts, makers, parsers
from maskline.operators.parsers import aliased

# The column order of each layout, and the canonical names.
_PAN_HEAD = [
    "future_use1", "receive_time", "serial_number", "type", "threat_content_type", "future_use2", "generated_time", "src_ip", "dest_ip",
    "nat_src_ip", "nat_dest_ip", "rule_name", "src_user", "dest_user", "application", "virtual_system", "src_zone", "dest_zone",
    "inbound_if", "outbound_if", "log_action", "future_use3", "session_id", "repeat_count", "src_port", "dest_port", "nat_src_port",
    "nat_dest_port", "flags", "protocol", "action",
]
PALO_ALTO_TRAFFIC = [
    *_PAN_HEAD,
    "bytes", "bytes_out", "bytes_in", "packets", "start_time", "duration", "category", "future_use4", "sequence_number", "action_flags",
    "src_location", "dest_location", "future_use5", "packets_out", "packets_in", "session_end_reason",
]
PALO_ALTO_THREAT = [
    *_PAN_HEAD,
    "url_filename", "threat_id", "category", "severity", "direction", "sequence_number", "action_flags", "src_location", "dest_location",
    "future_use4", "content_type", "pcap_id", "filedigest", "cloud", "url_idx", "user_agent", "file_type", "xff", "referer", "sender",
    "subject", "recipient",
]
PALO_ALTO_SYSTEM = [
    "future_use1", "receive_time", "serial_number", "type", "subtype", "future_use2", "generated_time", "virtual_system", "event_id",
    "object", "future_use3", "future_use4", "module", "severity", "description", "sequence_number", "action_flags", "dg_hier_level_1",
    "dg_hier_level_2", "dg_hier_level_3", "dg_hier_level_4", "virtual_system_name", "device_name",
]
VPC_DEFAULT = [
    "version", "account_id", "interface_id", "src_ip", "dest_ip", "src_port", "dest_port", "ip_protocol", "packets", "bytes", "start",
    "end", "action", "log_status",
]
VPC_V5 = [
    "vpc_id", "subnet_id", "instance_id", "tcp_flags", "traffic_type", "pkt_src_ip", "pkt_dest_ip", "region", "az_id", "sublocation_type",
    "sublocation_id", "pkt_src_aws_service", "pkt_dst_aws_service", "direction", "traffic_path",
]
VPC_ECS = [
    "ecs_cluster_arn", "ecs_cluster_name", "ecs_container_instance_arn", "ecs_container_instance_id", "ecs_container_id",
    "ecs_second_container_id", "ecs_service_name", "ecs_task_definition_arn", "ecs_task_arn", "ecs_task_id",
]
VPC_TRANSIT = [
    "version", "resource_type", "account_id", "tgw_id", "tgw_attachment_id", "tgw_src_vpc_account_id", "tgw_dst_vpc_account_id",
    "tgw_src_vpc_id", "tgw_dst_vpc_id", "tgw_src_subnet_id", "tgw_dst_subnet_id", "tgw_src_eni", "tgw_dst_eni", "tgw_src_az_id",
    "tgw_dst_az_id", "tgw_pair_attachment_id", "src_ip", "dest_ip", "src_port", "dest_port", "ip_protocol", "packets", "bytes", "start",
    "end", "log_status", "traffic_type", "packets_lost_no_route", "packets_lost_blackhole", "packets_lost_mtu_exceeded",
    "packets_lost_ttl_expired", "tcp_flags", "region", "direction", "pkt_src_aws_service", "pkt_dst_aws_service",
]
VPC_CUSTOM = [
    "version", "vpc_id", "subnet_id", "instance_id", "interface_id", "account_id", "traffic_type", "src_ip", "dest_ip", "src_port",
    "dest_port", "pkt_src_ip", "pkt_dest_ip", "ip_protocol", "bytes", "packets", "start", "end", "action", "tcp_flags", "log_status",
]
#: Sources of JSON lines: canonical name -> the paths it is taken from.
JSON_NAMES = {
    "aws_cloudtrail": {
        "api_operation": "eventName", "event_code": "eventName", "cloud_service": "eventSource", "cloud_region": "awsRegion",
        "cloud_account": "recipientAccountId", "request_id": "requestID", "event_uid": "eventID", "error_code": "errorCode",
        "error_message": "errorMessage", "user_agent": "userAgent", "dest_host": "eventSource", "log_time": "eventTime",
    },
    "barracuda_cloudgen_firewall": {
        "src_ip": "src_ip source_ip", "dest_ip": "dst_ip destination_ip", "src_port": "src_port source_port",
        "dest_port": "port destination_port dst_port", "action": "operation action", "log_time": "timestamp", "transport": "trans_proto",
        "url": "name", "signature": "description", "app": "component",
    },
    "crowdstrike_falcon": {
        "src_ip": "LocalAddressIP4 LocalAddressIP6", "dest_ip": "RemoteAddressIP4 RemoteAddressIP6", "dvc_id": "aid", "sensor_id": "aid",
        "customer_id": "cid", "src": "LocalAddressIP4 LocalAddressIP6 aid", "external_ip": "aip", "platform": "event_platform",
        "event_type": "event_simpleName", "event_id": "id", "signature": "event_simpleName", "log_time": "timestamp ContextTimeStamp",
    },
    "gcp_audit": {"event_uid": "insertId", "request_id": "insertId", "log_name": "logName", "log_time": "timestamp"},
    "o365_management_activity": {
        "log_time": "CreationTime", "user": "UserId MailboxOwnerUPN", "src_ip": "ClientIP ClientIPAddress ActorIpAddress", "action": "Operation",
        "outcome": "ResultStatus", "app": "Workload", "event_code": "RecordType", "event_uid": "Id",
    },
    "okta_system": {
        "log_time": "published", "event_code": "eventType", "signature": "displayMessage eventType", "action": "outcome.result",
        "user": "actor.alternateId", "user_id": "actor.id", "src_ip": "client.ipAddress", "user_agent": "client.userAgent.rawUserAgent",
    },
    "suricata_ids": {"log_time": "timestamp", "transport": "proto", "action": "event_type", "app": "app_proto"},
}
#: Sources of key=value lines.
PAIR_NAMES = {
    "sap_audit": {"user": "USER SUNAME", "src_user": "USER SUNAME", "host": "HOST", "message": "TEXT", "app": "TCODE", "report": "REPORT"},
    "sonicwall_firewall": {
        "log_time": "time", "action": "fw_action msg", "bytes_in": "rcvd", "bytes_out": "sent", "user": "usr", "host": "fw", "message": "msg",
    },
    "sophos_xg": {
        "dest_ip": "dst_ip dst", "dest_port": "dst_port", "user": "user_name user", "action": "log_subtype status", "transport": "protocol",
        "app": "log_component log_type", "bytes_in": "recv_bytes bytes_received", "bytes_out": "sent_bytes bytes_sent", "host": "device_name",
        "signature": "log_subtype message",
    },
}
SCORED_LINES, SCORED_FIELDS = 12, 3


def _named(cells: Column, names: list[str], optional: list[list[str]] = []) -> Column:
    """The first cells by name; each optional tail counts only if it is there whole."""
    n, size = F.lit(len(names)), len(names)
    for tail in optional:
        size += len(tail)
        names = names + tail
        n = F.when(F.size(cells) >= size, size).otherwise(n)
    own = F.map_from_arrays(F.slice(F.array(*map(F.lit, names)), F.lit(1), n), F.slice(cells, F.lit(1), n))
    return F.when(F.size(cells) >= n, own)


def aws_vpc(raw: Column) -> Column:
    """Flow records: default (14, 29, 39 or 40 fields), vpc-id first, or transit gateway; a message envelope is taken off."""
    text = F.coalesce(F.nullif(F.regexp_extract(raw, r'^\s*\{.*?"message"\s*:\s*"([^"]*)"', 1), F.lit("")), raw)
    cells = F.split(F.trim(text), r"\s+")
    found = (
        F.when(text.rlike(r"^\s*\d+\s+\S+\s+\d{12}\s+tgw-"), _named(cells, VPC_TRANSIT)).when(text.rlike(r"^\s*\d+\s+vpc-"), _named(cells, VPC_CUSTOM))
        .when(text.rlike(r"^\s*\d+\s"), _named(cells, VPC_DEFAULT, [VPC_V5, VPC_ECS, ["reject_reason"]]))
    )
    return aliased(found, {"dev_id": "interface_id tgw_src_eni", "cloud_account_id": "account_id", "cloud_region": "region", "cloud_zone": "az_id"})


def access_log(raw: Column) -> Column:
    """Common and combined web access lines."""
    head = (
        r'^(?<src_ip>\S+)\s+(?<ident>\S+)\s+(?<user>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"(?<http_method>\w+)\s+(?<uri>\S+)\s+(?<http_version>[^"]+)"'
        r"\s+(?<status>\d+)\s+(?<bytes>\d+)"
    )
    both = head + r'\s+"(?<http_referrer>[^"]*)"\s+"(?<http_user_agent>[^"]*)"'
    combined = parsers.regex(raw, both)
    return aliased(F.when(F.size(combined) > 0, combined).otherwise(parsers.regex(raw, head)), {"url": "uri"})


def palo_alto_system(raw: Column) -> Column:
    return aliased(parsers.delimited(raw, PALO_ALTO_SYSTEM), {"host": "device_name", "message": "description"})


def linux_audit(raw: Column) -> Column:
    pairs = parsers.kvp(raw)
    head = parsers.regex(raw, r"type=(?<audit_type>\w+)\s+msg=audit\((?<audit_epoch>[\d.]+):(?<audit_serial>\d+)\)")
    found = F.map_concat(F.map_filter(pairs, lambda k, v: ~F.array_contains(F.map_keys(head), k)), head)
    chains = {
        "log_time": "audit_epoch", "process": "exe comm", "process_name": "comm exe", "command": "exe comm", "user_id": "uid",
        "audit_user_id": "auid", "session_id": "ses", "signature": "audit_type", "object": "key", "rule_name": "key",
    }
    return aliased(found, chains)


CATALOGUE: dict[str, Callable[[Column], Column]] = {
    "apache_access": access_log,
    "aws_vpc_v2": aws_vpc,
    "aws_vpc_v5": aws_vpc,
    "leef": parsers.leef,
    "linux_audit": linux_audit,
    "nginx_access": access_log,
    "palo_alto_system": palo_alto_system,
    "palo_alto_threat": lambda raw: parsers.delimited(raw, PALO_ALTO_THREAT),
    "palo_alto_traffic": lambda raw: parsers.delimited(raw, PALO_ALTO_TRAFFIC),
}
CATALOGUE |= {k: lambda raw, names=names: aliased(parsers.kvp(raw), names) for k, names in PAIR_NAMES.items()}
CATALOGUE |= {k: lambda raw, names=names: aliased(parsers.json_leaves(raw), names) for k, names in JSON_NAMES.items()}
CATALOGUE |= layouts.LAYOUTS | layouts.MARKED | makers.LAYOUTS | makers.MARKED


def parsed(lines: DataFrame, sourcetype: str) -> DataFrame:
    """(sample_id, line_no, fields) by the source's layout."""
    return lines.select("sample_id", "line_no", CATALOGUE[sourcetype](F.col("raw")).alias("fields"))


def best_parser(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(sample_id, sourcetype, parsed, fields): the layout that reads most of each sample's first lines, then most fields.

    A layout has to read half of the lines and find three fields; each line is
    tried with every layout inside its own row.  JSON and XML lines, whose
    layouts look alike, are left to their signatures.
    """
    lines = lines.where(~F.col("raw").rlike(r"^\s*[{<\[](?!\d)"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("line_no"))
    first = lines.withColumn("place", place).where(F.col("place") <= SCORED_LINES)
    names = names or sorted(CATALOGUE.keys() - JSON_NAMES.keys() - layouts.MARKED.keys() - makers.MARKED.keys())
    tries = F.array(*[F.struct(F.lit(n).alias("sourcetype"), F.map_keys(CATALOGUE[n](F.col("raw"))).alias("keys")) for n in names])
    each = first.select("sample_id", "line_no", F.explode(tries).alias("t")).select("sample_id", "line_no", "t.*")
    read = F.coalesce(F.size("keys"), F.lit(0)) > 0
    scored = each.groupBy("sample_id", "sourcetype").agg(
        F.count("*").alias("n"), F.count_if(read).alias("parsed"), F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("fields")
    )
    good = scored.where((F.col("parsed") * 2 >= F.col("n")) & (F.col("fields") >= SCORED_FIELDS))
    order = Window.partitionBy("sample_id").orderBy(F.desc("parsed"), F.desc("fields"), "sourcetype")
    return good.withColumn("r", F.row_number().over(order)).where("r = 1").select("sample_id", "sourcetype", "parsed", "fields")
