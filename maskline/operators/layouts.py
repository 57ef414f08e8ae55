"""Layouts of syslog, firewall, Zeek and Windows event lines, on the parts that ``parsers`` has.

A syslog line is read as a header, by the old or the new standard, and a
message; patterns for what a program writes add fields where they fit.
Canonical names come from alias chains; values stay as written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.operators import parsers
from maskline.operators.parsers import aliased

_CLOCK = r"[A-Z][a-z]{2}\s+\d{1,2}(?:\s+\d{4})?\s+\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+\-]\d{2}:?\d{2})?"
OLD = rf"^(?:<(?<syslog_pri>\d{{1,3}})>)?(?<log_time>{_CLOCK})\s+(?<host>\S+)\s+(?<process>[^\s\[:]+)(?:\[(?<pid>\d+)\])?:\s+(?<message>.+)$"
#: As pfSense writes it: no host.
HOSTLESS = rf"^<(?<syslog_pri>\d{{1,3}})>(?<log_time>{_CLOCK})\s+(?<process>[^\s\[:]+)(?:\[(?<pid>\d+)\])?:\s+(?<message>.*)$"
NEW = r"^<(?<syslog_pri>\d{1,3})>\d+\s+(?<log_time>\S+)\s+(?<host>\S+)\s+(?<process>\S+)\s+(?<pid>\S+)\s+\S+\s+(?<message>.*)$"
#: As Cisco's firewalls write it: the host is optional, the message code follows a percent sign.
CISCO = (
    rf"^(?:<(?<syslog_pri>\d{{1,3}})>)?(?:(?<log_time>{_CLOCK})\s*+)?(?:(?<host>[^\s:%]++)\s*+)?+:?+\s*+"
    r"%(?<device>ASA|FTD)-(?:\S*-)?(?<severity>\d)-(?<event_code>\d+):\s+(?<message>.*)$"
)
IP = r"\d{1,3}(?:\.\d{1,3}){3}"

SSHD = r"\b(?<action>Accepted|Failed|Invalid)\s+(?<auth_method>\S+)\s+for\s+(?:invalid user\s+)?(?<user>\S+)\s+from\s+(?<src_ip>\S+)\s+port\s+(?<src_port>\d+)"
SUDO = r"(?<!\S)(?<user>\S++)\s++:\s.*\bUSER=(?<runas_user>[^\s;]+)\s*;\s*COMMAND=(?<command>.+)"
SESSION = r"session (?:opened|closed) for user (?<user>[^\s(]+)"
UFW = (
    r"\[UFW (?<action>\w+)\].*?\bSRC=(?<src_ip>\S+) DST=(?<dest_ip>\S+).*?\bPROTO=(?<transport>\w+)(?:.*?\bSPT=(?<src_port>\d+) DPT=(?<dest_port>\d+))?"
)
#: The packet filter's comma list: action and direction, then seven cells on, the protocol and both ends.
FILTERLOG = (
    rf",(?<action>block|pass|reject),(?<direction>in|out),4,(?:[^,]*,){{7}}(?<transport>[a-z]+),\d+,(?<src_ip>{IP}),(?<dest_ip>{IP})"
    r"(?:,(?<src_port>\d+),(?<dest_port>\d+))?"
)
DNS_QUERY = (
    r"\bclient\s+(?:@\S+\s+)?(?<src_ip>[^\s#]+)#(?<src_port>\d+)[^:]*:\s+(?:(?<transport>[A-Za-z]+):\s+)?query:\s+(?<query>\S+)\s+(?<query_class>\w+)"
    r"\s+(?<query_type>\w+)(?:\s+response:\s+(?<reply_code>\w+))?"
)
DHCP_LEASE = rf"^(?<dhcp_action>DHCP\w+)(?: (?:for|on) (?<lease_ip>{IP}))? (?:from|to) (?<src_mac>[0-9a-f:]{{17}})(?: \((?<client_host>[^)]+)\))?(?: via (?<via>\S+))?"
#: Ends of a connection in Cisco's messages, interface:address/port, and a user where one is named.
CISCO_PAIR = (
    rf"(?:(?<!\w)(?<protocol>\w++)\s++)?(?:connection \d+ )?(?:for|src|from)\s+(?<src_interface>[\w\-]+):(?<src_ip>{IP})/(?<src_port>\d+)"
    rf".*?\b(?:to|dst)\s+(?<dest_interface>[\w\-]+):(?<dest_ip>{IP})/(?<dest_port>\d+)"
)
CISCO_ACTION = r"^(?<action>Built|Teardown|Deny|Denied|Permitted|Accessed|Login permitted|Login denied)\b"
CISCO_USER = r"(?i)\b(?:user(?:name)?)\s*[=:]?\s*[<'\"]?(?<user>[\w.\\\-@$]+)"


def merged(first: Column, second: Column) -> Column:
    """Both maps; of equal names the first's value.  The first is computed once, not again for each key of the second."""
    return parsers.let(first, lambda own: F.map_concat(F.map_filter(second, lambda k, v: ~F.array_contains(F.map_keys(own), k) & (v != "")), own))


def _filled(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))


def syslog(headers: list[str], messages: list[str] = (), chains: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A layout: the first header that fits, then what each pattern finds in the message."""
    def read(raw: Column) -> Column:
        head = F.create_map().cast("map<string,string>")
        for pattern in reversed(headers):
            head = F.when(raw.rlike(parsers.numbered(pattern)), parsers.regex(raw, pattern)).otherwise(head)

        def with_message(found: Column) -> Column:
            out = _filled(found)
            for pattern in messages:
                out = parsers.let(out, lambda m, p=pattern: merged(m, _filled(parsers.regex(F.coalesce(m["message"], F.lit("")), p))))
            return parsers.let(out, lambda m: aliased(m, chains)) if chains else out

        return parsers.let(head, with_message)

    return read


def fortigate(raw: Column) -> Column:
    """Pairs, or the extension of a CEF line, whose own names lose their prefix."""
    pairs = F.map_entries(F.when(raw.contains("CEF:"), parsers.cef(raw)).otherwise(parsers.kvp(raw)))
    bare = F.transform(pairs, lambda e: F.struct(F.regexp_replace(e["key"], "^FTNTFGT", "").alias("key"), e["value"].alias("value")))
    return parsers.let(parsers.last_wins(bare), lambda m: aliased(m, FORTIGATE))


FORTIGATE = {
    "src_ip": "src_ip src srcaddr srcip", "dest_ip": "dest_ip dst_ip dst dstaddr dstip", "src_port": "src_port spt srcport",
    "dest_port": "dest_port dst_port dpt dstport", "transport": "transport protocol proto", "action": "action act", "event_code": "event_code logid",
    "message": "msg type", "log_time": "eventtime date", "host": "host devname devid", "bytes_in": "bytes_in in rcvdbyte", "bytes_out": "out sentbyte",
    "app": "app service appcat", "src_interface": "srcintf", "dest_interface": "dstintf", "src_country": "srccountry", "dest_country": "dstcountry",
    "policy_id": "policyid", "policy_name": "policyname poluuid", "session_id": "sessionid externalId identifier", "src_mac": "srcmac mastersrcmac",
    "dest_mac": "dstmac masterdstmac", "vdom": "vd vdom", "packets_in": "rcvdpkt", "packets_out": "sentpkt", "dev_id": "devid", "os": "osname",
    "severity": "level severity", "nat_disposition": "trandisp",
}


def juniper(raw: Column) -> Column:
    """The structured data's pairs, by their canonical names."""
    chains = {
        "src_ip": "source-address", "src_port": "source-port", "dest_ip": "destination-address", "dest_port": "destination-port",
        "transport": "protocol-name", "app": "service-name application application-name", "action": "policy-name attack-name", "user": "username",
    }
    head = F.map_filter(parsers.regex(raw, NEW), lambda k, v: k.isin("log_time", "host", "process") & (v != ""))
    return parsers.let(parsers.kvp(raw), lambda m: F.when(F.map_contains_key(m, F.lit("source-address")), merged(head, aliased(m, chains))).otherwise(head))


def zeek(raw: Column) -> Column:
    """JSON, behind a syslog header or not."""
    chains = {
        "src_ip": "id.orig_h", "src_port": "id.orig_p", "dest_ip": "id.resp_h", "dest_port": "id.resp_p", "transport": "proto", "bytes_in": "resp_bytes",
        "bytes_out": "orig_bytes", "action": "conn_state", "session_id": "uid", "log_time": "ts",
    }
    body = F.regexp_replace(raw, r"^[^{]*(?=\{)", "")
    return parsers.let(F.coalesce(parsers.json_leaves(body), F.create_map().cast("map<string,string>")), lambda m: aliased(m, chains))


def windows_event(raw: Column) -> Column:
    """Leaves and named Data of an <Event>, with the attributes of its System part."""
    head = parsers.regex(raw, r"<Provider Name=['\"](?<provider>[^'\"]+)['\"]")
    time = parsers.regex(raw, r"<TimeCreated SystemTime=['\"](?<system_time>[^'\"]+)['\"]")
    chains = {
        "event_code": "EventID", "host": "Computer", "log_time": "system_time", "user": "TargetUserName SubjectUserName User",
        "src_user": "SubjectUserName", "user_domain": "TargetDomainName SubjectDomainName", "src_ip": "IpAddress SourceIp SourceAddress",
        "src_port": "IpPort SourcePort", "dest_ip": "DestinationIp DestAddress", "dest_port": "DestinationPort DestPort", "src_host": "WorkstationName SourceHostname",
        "dest_host": "DestinationHostname", "process": "NewProcessName Image ProcessName", "parent_process": "ParentProcessName ParentImage",
        "command": "CommandLine ProcessCommandLine", "process_id": "NewProcessId ProcessId", "logon_type": "LogonType", "query": "QueryName",
        "file_hash": "Hashes", "signature": "ThreatName Threat Name", "service": "ServiceName param1", "script": "ScriptBlockText",
    }
    return parsers.let(merged(merged(_filled(parsers.xml(raw)), head), time), lambda m: F.when(raw.contains("<Event"), aliased(m, chains)).otherwise(F.create_map().cast("map<string,string>")))


LAYOUTS: dict[str, Callable[[Column], Column]] = {
    "cisco_asa": syslog([CISCO], [CISCO_ACTION, CISCO_PAIR, CISCO_USER]),
    "cisco_ftd": syslog([CISCO], [CISCO_ACTION, CISCO_PAIR, CISCO_USER]),
    "fortinet_fortigate": fortigate,
    "infoblox_dns": syslog([OLD], [DNS_QUERY, DHCP_LEASE], {"dest_ip": "lease_ip", "src_host": "client_host", "url": "query", "event_code": "dhcp_action reply_code"}),
    "juniper_srx": juniper,
    "linux_secure": syslog([OLD], [SSHD, SUDO, SESSION], {"app": "process", "event_code": "process"}),
    "linux_syslog": syslog([OLD], [SSHD, SUDO, UFW], {"app": "process", "event_code": "process"}),
    "pfsense": syslog([NEW, HOSTLESS], [FILTERLOG], {"app": "process"}),
    "vsphere": syslog([NEW], [], {"app": "process", "dest": "host"}),
}
#: Layouts of JSON and XML lines, which signatures tell apart and scoring does not try.
MARKED = {
    **{name: zeek for name in ("zeek_conn", "corelight_conn", "corelight_dns", "corelight_http", "corelight_ssl", "corelight_notice", "corelight_weird")},
    **{f"windows_{name}": windows_event for name in ("security", "sysmon", "dns_client", "defender", "system", "application", "powershell")},
}
