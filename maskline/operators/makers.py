"""Layouts of sources that write several forms: CEF by its key dictionary, Check Point, F5, Zscaler, Salesforce, Cisco mail and Umbrella.

A layout tells its forms apart by the line itself, so one sample may mix them.
Custom CEF fields also get the name that their label gives, which only the line
knows.  A line of no form gives an empty map; values stay as written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.functions import times
from maskline.operators import layouts, parsers
from maskline.operators.layouts import _filled, merged
from maskline.operators.parsers import aliased, let

_CELL = r"(?:[^|\\]|\\.)*+"
CEF_HEAD = (
    rf"CEF:(?<cef_version>\d+)\|(?<device_vendor>{_CELL})\|(?<device_product>{_CELL})\|(?<device_version>{_CELL})"
    rf"\|(?<signature_id>{_CELL})\|(?<name>{_CELL})\|(?<severity_raw>{_CELL})\|"
)
ENVELOPE = (
    r"^<(?<syslog_pri>\d{1,3})>(?:\d\s+)?(?<envelope_time>[A-Za-z]{3}\s+\d{1,2}\s+[\d:]{8}|\d{4}-\d{2}-\d{2}T[\d:.]++(?:Z|[+\-]\d{2}:?\d{2})?)"
    r"\s+(?<device_host>\S+)\s[^|]*?CEF:"
)
# Canonical names and the keys of the published CEF dictionary, or of a source, that they are taken from.
CEF_NAMES = {
    "src_ip": "src", "src_port": "spt", "src_host": "shost", "src_mac": "smac", "src_user": "suser", "src_zone": "sourceZoneURI",
    "src_translated_ip": "sourceTranslatedAddress", "src_translated_port": "sourceTranslatedPort", "dest_ip": "dst", "dest_port": "dpt",
    "dest_host": "dhost", "dest_mac": "dmac", "dest_user": "duser", "dest_zone": "destinationZoneURI",
    "dest_translated_ip": "destinationTranslatedAddress", "dest_translated_port": "destinationTranslatedPort", "transport": "proto",
    "app": "app destinationServiceName", "protocol": "app", "action": "act", "category": "cat", "bytes_in": "in", "bytes_out": "out",
    "device_ip": "dvc", "device_host": "dvchost device_host", "message": "msg", "request_url": "request",
    "user_agent": "requestClientApplication", "file_name": "fname", "file_path": "filePath", "file_hash": "fileHash", "file_size": "fsize",
    "event_code": "signature_id", "signature": "name", "session_id": "externalId", "vendor": "device_vendor", "product": "device_product",
    "host": "host device_host dvchost shost", "user": "suser duser", "log_time": "rt end envelope_time",
}
CEF_CUSTOM = ("cs1", "cs2", "cs3", "cs4", "cs5", "cs6", "cn1", "cn2", "cn3")
CHECKPOINT_CEF = {"origin_ip": "origin_ip origin orig", "direction": "direction deviceDirection", "src_zone": "src_zone ifname", "app": "app service_id", "rule_name": "rule_name cs2"}
CHECKPOINT = {
    "src_port": "src_port s_port", "dest_port": "dst_port service", "transport": "proto protocol", "action": "action rule_action",
    "host": "host hostname syslog_host", "rule_id": "rule_uid", "direction": "ifdir conn_direction", "src_zone": "ifname",
    "user": "user src_user_name", "event_code": "logid", "device_ip": "syslog_host", "session_id": "loguid", "dev_id": "loguid machineid",
    "origin_ip": "origin orig", "bytes_in": "received client_inbound_bytes bytes_in", "bytes_out": "sent client_outbound_bytes bytes_out",
    "src_translated_ip": "xlatesrc nat_addtnl_rulenum", "dest_translated_ip": "xlatedst", "src_translated_port": "xlatesport",
    "dest_translated_port": "xlatedport", "rule": "rule_name rule", "log_time": "time log_time",
}
ZSCALER = {
    "log_time": "datetime rt", "src_ip": "clientip ClientIP clientpublicIP src", "dest_ip": "serverip ServerIP dst",
    "host": "devicehostname hostname host", "dest_port": "serverport dpt", "bytes_in": "responsesize in", "bytes_out": "requestsize out",
    "user": "login user", "url": "url request", "url_category": "urlcategory cat", "app": "appname app", "http_method": "requestmethod",
    "http_status": "status outcome",
}
SALESFORCE = {
    "action": "Action", "signature": "Action", "event_code": "Action", "user": "DelegateUser CreatedById", "src_user": "DelegateUser CreatedById",
    "user_id": "CreatedById", "delegate_user": "DelegateUser", "message": "Display", "object": "Section", "category": "Section",
    "namespace": "ResponsibleNamespacePrefix", "context": "CreatedByContext", "issuer": "CreatedByIssuer", "event_id": "Id",
    "log_time": "CreatedDate",
}

_STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
_F5 = r"^(?:<(?<syslog_pri>\d{1,3})>)?(?<timestamp>\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<host>[\w.\-]+)\s+(?<severity>\w+)\s+(?<process>[\w\-]+)\[(?<pid>\d+)\]:\s+"
F5_HEADS = [_F5 + r"(?<msg_id>\d++(?::\d++)*+):\s+(?<message>.+)$", _F5 + r"(?<message>.+)$"]
F5_PARTS = [
    r"(?i)\bclient\s+(?<src_ip>[\d.]+):(?<src_port>\d+)", r"(?i)\b(?:member|node|server)\s+(?:\S*/)?(?<dest_ip>[\d.]+):(?<dest_port>\d+)", r"(?i)\bpool\s+(?<pool>\S+)",
    r"(?i)\bvirtual\s+(?<virtual>\S+)", r"(?i)\bstatus\s+(?<status_code>\d{3})\b",
    r"\bAUDIT\b(?:(?!\buser=|\bAUDIT\b).)*+\buser=(?<user>\S+)(?:\s+folder=(?<folder>\S+))?(?:\s+module=(?<module>\S+))?(?:\s+status=\[(?<status>[^\]]*)\])?(?:\s+cmd_data=(?<cmd_data>.+))?",
    r"(?i)(?<ssl_event>\bSSL[\w\s()]{0,200}?(?:failed|error|success))", r"(?i)\b(?<action>down|up|failed|success|blocked|denied|reload|reset|disconnect)\b",
]
ESA_HEAD = r"^(?<log_time>\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})\s+(?<level>Info|Warning|Critical|Debug|Trace):\s+(?<message>.*)$"
ESA_PARTS = [
    r"\bMID\s+(?<mid>\d+)", r"\bICID\s+(?<icid>\d+)", r"\bDCID\s+(?<dcid>\d+)", r"\bRID\s+\[?(?<rid>\d+)", r"\bFrom:\s+<?(?<sender>[^>\s]+)",
    r"^New SMTP ICID \d+ interface (?<interface>\S+).*?address (?<src_ip>[\d.]+) reverse dns host (?<reverse_dns>\S+) verified (?<dns_verified>\w+)",
    r"\bTo:\s+<?(?<recipient>[^>\s]+)", r"\bSubject\s+'(?<subject>[^']*)'", r"\bMessage-ID\s+'(?<message_id>[^']+)'", r"\bready\s+(?<message_size>\d+)\s+bytes",
    r"\bper-recipient policy\s+(?<mail_policy>\S+)", r"\busing engine:\s+(?<scan_engine>\S+)\s+spam\s+(?<spam_verdict>\w+)", r"\bantivirus\s+(?<av_verdict>\w+)(?:\s+'(?<av_name>[^']+)')?",
]
UMBRELLA_DNS = ["log_time", "identity", "identities", "src_ip", "external_ip", "action", "query_type", "reply_code", "query"]
UMBRELLA_PROXY = ["log_time", "identity", "src_ip", "external_ip", "dest_ip", "content_type", "action", "url"]

#: key:"value"; pairs, and pairs between bars.
_SEMICOLONS = r'(?:^|;\s*+|\s)([\w.\-]++):("(?:[^"\\]|\\.)*+"|[^;\s"]*+)'
_BARS = r"(?:^|\|)([^=|]++)=([^|]*+)"


def _none() -> Column:
    return F.create_map().cast("map<string,string>")


def _constant(fields: Column, **more: str) -> Column:
    return merged(fields, F.create_map(*[F.lit(x) for pair in more.items() for x in pair]))


def _unquoted(raw: Column) -> Column:
    """The line without quotes around all of it."""
    whole = (F.length(raw) > 2) & raw.startswith('"') & raw.endswith('"')
    return F.when(whole, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def cef_dictionary(raw: Column) -> Column:
    """A CEF line's header, extension and envelope, custom fields under their labels, canonical names and a severity from 0 to 10."""
    def labelled(m: Column) -> Column:
        """Custom fields that have a label, by it; characters that no name has become underscores."""
        pairs = F.filter(F.array(*[F.struct(m[f"{c}Label"].alias("key"), m[c].alias("value")) for c in CEF_CUSTOM]), lambda e: (e["key"] != "") & e["value"].isNotNull())
        named = F.transform(pairs, lambda e: F.struct(F.regexp_replace(e["key"], "[^A-Za-z0-9_]", "_").alias("key"), e["value"].alias("value")))
        return merged(parsers.last_wins(named), m)

    def named(m: Column) -> Column:
        maker = F.nullif(F.trim(F.concat_ws(" ", m["device_vendor"], m["device_product"])), F.lit(""))
        more = F.create_map(F.lit("vendor_product"), maker, F.lit("severity"), times.severity(m["severity_raw"]).cast("string"))
        return merged(_filled(more), aliased(m, CEF_NAMES))

    def read(line: Column) -> Column:
        found = merged(merged(_filled(parsers.regex(line, CEF_HEAD)), _filled(parsers.regex(line, ENVELOPE))), F.coalesce(_filled(parsers.cef(line)), _none()))
        return F.when(line.rlike(parsers.numbered(CEF_HEAD)), let(let(found, labelled), named)).otherwise(_none())

    return let(_unquoted(raw), read)


def checkpoint(raw: Column) -> Column:
    """CEF, JSON, and pairs after a syslog header of either standard or none: with semicolons, bars, or spaces between them."""
    new = r"^<(?<priority>\d+)>(?<syslog_version>\d+)\s+(?<log_time>\S+)\s+(?<syslog_host>\S+)\s+(?<app_name>\S+)\s+(?<procid>\S+)\s+(?<msgid>\S+)\s+\[(?<__body>.*)\]$"
    numbered = r"^\d+\s+<\d+>\d+\s+(?<log_time>\S+)\s+(?<syslog_host>\S+)\s+(?<__body>.*)$"
    bsd = r"^(?<log_time>\w{3}\s+\d+\s+[\d:]+)\s+(?<syslog_host>\S+)\s+(?<__body>.*)$"
    head = parsers.regex(raw, bsd, scratch=True)
    for pattern in (numbered, new):
        head = F.when(raw.rlike(parsers.numbered(pattern)), parsers.regex(raw, pattern, scratch=True)).otherwise(head)

    def pairs(m: Column) -> Column:
        body = F.coalesce(F.nullif(m["__body"], F.lit("")), raw)
        bars = F.when(body.rlike(r"^\s*[^=|\s]+=[^|]*\|"), parsers.kvp(body, _BARS)).otherwise(parsers.kvp(body))
        found = F.when(body.rlike(r'[\w.\-]:"'), parsers.kvp(body, _SEMICOLONS)).otherwise(bars)
        return merged(found, F.map_filter(m, lambda k, v: ~k.startswith("__") & (v != "")))

    def named(m: Column) -> Column:
        first = lambda a, b: F.coalesce(F.nullif(F.substring_index(m[a], " ", 1), F.lit("")), m[b])
        ends = F.create_map(F.lit("src_ip"), first("src", "srcaddr"), F.lit("dest_ip"), first("dst", "dstaddr"), F.lit("severity"), F.coalesce(F.nullif(m["severity"], F.lit("")), F.lit("6")))
        made = _constant(merged(_filled(ends), aliased(m, CHECKPOINT)), app="Check Point Firewall", vendor_product="Check Point Software Firewall")
        return F.when(F.size(m) > 0, made).otherwise(_none())

    json = F.coalesce(parsers.json_leaves(raw), _none())
    own = let(F.when(raw.rlike(r"^\s*\{"), json).otherwise(let(head, pairs)), named)
    marked = let(cef_dictionary(raw), lambda m: aliased(m, CHECKPOINT_CEF))
    return F.when(raw.rlike(r"CEF:\d+\|"), marked).otherwise(own)


def zscaler(raw: Column) -> Column:
    """Web proxy records: pairs between tabs, a CEF line, or JSON, whose event may be inside; quotes around a line go."""
    pairs = r'(?:^|\t)([\w.\-]++)=("(?:[^"\\]|\\.)*+"|[^\t]*+)'

    def read(line: Column) -> Column:
        inner = F.coalesce(F.get_json_object(line, "$.event"), line)
        head = parsers.regex(line, CEF_HEAD)
        # In these CEF lines the fifth and sixth cells are the action and its reason.
        cells = F.map_filter(F.transform_keys(head, lambda k, v: F.when(k == "signature_id", "action").when(k == "name", "reason").when(k == "severity_raw", "severity").otherwise(k)), lambda k, v: k != "cef_version")
        found = (
            F.when(line.startswith("{"), F.coalesce(parsers.json_leaves(inner), _none()))
            .when(line.rlike(r"CEF:\d+\|"), merged(F.coalesce(parsers.cef(line), _none()), _filled(cells)))
            .when(line.contains("\t"), parsers.kvp(line, pairs)).otherwise(parsers.kvp(line))
        )
        return let(found, lambda m: F.when(F.size(m) > 0, _constant(aliased(m, ZSCALER), vendor_product="Zscaler ZIA")).otherwise(_none()))

    return let(_unquoted(raw), read)


def salesforce(raw: Column) -> Column:
    """Setup audit records in JSON."""
    named = lambda m: F.when(F.size(m) > 0, _constant(aliased(m, SALESFORCE), outcome="success", severity="5")).otherwise(_none())
    return let(F.coalesce(parsers.json_leaves(raw), _none()), named)


def umbrella(raw: Column) -> Column:
    """Quoted comma lists of name lookups, whose fourth cell is the inner address, or of proxied requests, whose third is."""
    address = rf"^{layouts.IP}$"
    # The quote before the time may be gone, with that after it left.
    line = F.regexp_replace(raw, rf'^({_STAMP})"', '"$1"')

    def read(cells: Column) -> Column:
        def first(names: list[str]) -> Column:
            pairs = F.zip_with(F.array(*map(F.lit, names)), F.slice(cells, 1, len(names)), lambda k, v: F.struct(k.alias("key"), F.coalesce(v, F.lit("")).alias("value")))
            return _filled(parsers.last_wins(pairs))

        found = (
            F.when(F.get(cells, F.lit(3)).rlike(address) & (F.size(cells) >= len(UMBRELLA_DNS)), first(UMBRELLA_DNS))
            .when(F.get(cells, F.lit(2)).rlike(address) & F.get(cells, F.lit(7)).rlike("^https?:"), first(UMBRELLA_PROXY)).otherwise(_none())
        )

        def named(m: Column) -> Column:
            app = F.when(m["query"].isNotNull(), "DNS").otherwise("Proxy")
            more = _constant(merged(m, F.create_map(F.lit("app"), app)), vendor="Cisco", product="Umbrella", vendor_product="Cisco Umbrella")
            return F.when(F.size(m) > 0, aliased(more, {"user": "identity", "dns_query": "query"})).otherwise(_none())

        return let(found, named)

    return F.when(line.rlike(rf'^"{_STAMP}"'), let(parsers.cells(line), read)).otherwise(_none())


#: Layouts that scoring tries.
LAYOUTS: dict[str, Callable[[Column], Column]] = {
    "cef": cef_dictionary,
    "cisco_esa": layouts.syslog([ESA_HEAD], ESA_PARTS, {"user": "sender", "src_user": "sender", "dest_user": "recipient", "severity": "level"}),
    "cisco_umbrella": umbrella,
    "f5_bigip": layouts.syslog(F5_HEADS, F5_PARTS, {"log_time": "timestamp"}),
}
#: Layouts that a header, a signature or a name finds: their pairs look like anyone's.
MARKED = {"checkpoint_firewall": checkpoint, "salesforce_setupaudittrail": salesforce, "zscaler_web": zscaler}
