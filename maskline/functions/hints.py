"""Vendor hints, signatures and channels that names and samples are recognised by."""

from typing import NamedTuple

class Hint(NamedTuple):
    """Words that a source's name holds, and whose source it then is; ``glued``: a name of one word may begin with the first."""

    words: list[str]
    vendor: str
    product: str
    family: str
    glued: bool = False


# Vendors by the words of a name, in order of preference.
HINTS = [
    Hint(["citrix", "netscaler"], "Citrix", "NetScaler ADC", "network/appfw"),
    Hint(["netscaler"], "Citrix", "NetScaler ADC", "network"),
    Hint(["cloudflare", "gateway", "dns"], "Cloudflare", "Cloudflare Gateway", "dns"),
    Hint(["cloudflare", "gateway"], "Cloudflare", "Cloudflare Gateway", "web_gateway"),
    Hint(["cloudflare", "http"], "Cloudflare", "Cloudflare", "http"),
    Hint(["cloudflare"], "Cloudflare", "Cloudflare", "web"),
    Hint(["ironport", "wsa"], "Cisco", "IronPort Web Security Appliance", "web_proxy"),
    Hint(["cisco", "wsa"], "Cisco", "Web Security Appliance", "web_proxy"),
    Hint(["vcenter"], "VMware", "vCenter Server", "syslog"),
    Hint(["esxi"], "VMware", "ESXi", "syslog"),
    Hint(["bluecoat", "proxysg"], "Broadcom", "Blue Coat ProxySG", "web_proxy"),
    Hint(["bluecoat"], "Broadcom", "Blue Coat", "web_proxy"),
    Hint(["sharepoint"], "Microsoft", "SharePoint", "collaboration"),
    Hint(["azure", "eventhub"], "Microsoft", "Azure Event Hub", "cloud_ingest"),
    Hint(["aem"], "Adobe", "Experience Manager", "application", glued=True),
    Hint(["aws", "waf"], "AWS", "WAF", "web_firewall"),
    Hint(["juniper", "junos"], "Juniper", "Junos", "network"),
    Hint(["fpc"], "Full Packet Capture", "FPC metadata", "http_metadata"),
    Hint(["splunk", "soar"], "Splunk", "SOAR", "application"),
    Hint(["corelight"], "Corelight", "Corelight (Zeek)", "network"),
    Hint(["zeek"], "Zeek", "Zeek", "network", glued=True),
    Hint(["vmware", "esxlog"], "VMware", "ESXi host log", "syslog"),
    Hint(["ivanti"], "Ivanti", "Ivanti appliance", "application"),
    Hint(["ldap", "access", "log"], "LDAP server", "Directory access log", "directory"),
    Hint(["access", "log"], "Web Server", "Access log", "web"),
    Hint(["error", "log"], "Web Server", "Error log", "web"),
    Hint(["mod", "jk"], "Apache", "mod_jk connector", "web"),
    Hint(["modsec"], "Apache", "ModSecurity", "web_firewall", glued=True),
    Hint(["tenable"], "Tenable", "Tenable.sc / Tenable.ad", "vulnerability"),
    Hint(["securid"], "RSA", "SecurID", "authentication"),
    Hint(["netwitness"], "RSA", "NetWitness", "network"),
    Hint(["mcafee"], "McAfee", "ePO", "endpoint"),
    Hint(["nginx"], "NGINX", "NGINX", "web"),
    Hint(["bigip"], "F5", "BIG-IP", "network"),
    Hint(["tanium"], "Tanium", "Tanium", "endpoint"),
    Hint(["jira"], "Atlassian", "Jira", "application"),
    Hint(["trellix"], "Trellix", "Trellix", "endpoint", glued=True),
    Hint(["fidelis"], "Fidelis", "Fidelis", "network"),
    Hint(["delinea"], "Delinea", "Delinea (Thycotic)", "authentication"),
    Hint(["mandiant"], "Mandiant", "Advantage ASM", "threat_intel"),
    Hint(["forcepoint"], "Forcepoint", "Forcepoint", "email"),
    Hint(["symantec", "email"], "Broadcom", "Symantec Email Security.cloud", "email"),
    Hint(["fml"], "Fortinet", "FortiMail", "email"),
    Hint(["fortiproxy"], "Fortinet", "FortiProxy", "web_proxy", glued=True),
    Hint(["clearswift"], "Fortra", "Clearswift", "email"),
    Hint(["postfix"], "Postfix", "Postfix MTA", "email", glued=True),
    Hint(["brocade"], "Broadcom", "Brocade", "network"),
    Hint(["commvault"], "Commvault", "Commvault", "backup"),
    Hint(["ise"], "Cisco", "Identity Services Engine", "authentication"),
    Hint(["prime"], "Cisco", "Prime", "network"),
    Hint(["juniper"], "Juniper", "Junos", "network"),
    Hint(["trendmicro"], "Trend Micro", "Trend Micro", "endpoint", glued=True),
    Hint(["akamai"], "Akamai", "Akamai", "web"),
    Hint(["arbor"], "NETSCOUT", "Arbor", "network"),
    Hint(["solarwinds"], "SolarWinds", "SolarWinds", "network"),
    Hint(["misp"], "MISP", "MISP", "threat_intel", glued=True),
    Hint(["dmarc"], "DMARC", "DMARC aggregate", "email", glued=True),
    Hint(["zabbix"], "Zabbix", "Zabbix", "monitoring", glued=True),
    Hint(["elasticsearch"], "Elastic", "Elasticsearch", "application", glued=True),
    Hint(["websphere"], "IBM", "WebSphere", "application", glued=True),
    Hint(["mariadb"], "MariaDB", "MariaDB", "database", glued=True),
    Hint(["mssql"], "Microsoft", "SQL Server", "database", glued=True),
    Hint(["vsftpd"], "vsftpd", "vsftpd", "ftp", glued=True),
    Hint(["idrac"], "Dell", "iDRAC", "hardware", glued=True),
    Hint(["securetransport"], "Axway", "SecureTransport", "mft", glued=True),
    Hint(["dataminer"], "Skyline", "DataMiner", "monitoring", glued=True),
    Hint(["isva"], "IBM", "Security Verify Access", "authentication", glued=True),
    Hint(["ixia"], "Keysight", "Ixia", "network", glued=True),
    Hint(["hypori"], "Hypori", "Hypori", "application", glued=True),
    Hint(["attackiq"], "AttackIQ", "AttackIQ", "security"),
    Hint(["domaintools"], "DomainTools", "DomainTools", "threat_intel"),
    Hint(["teamcymru"], "Team Cymru", "Team Cymru", "threat_intel", glued=True),
    Hint(["apache"], "Apache", "HTTP Server", "web", glued=True),
    Hint(["pan", "audit"], "Palo Alto Networks", "PAN-OS", "audit"),
    Hint(["aws", "config"], "AWS", "Config", "cloud_audit"),
    Hint(["stash"], "Atlassian", "Bitbucket (Stash)", "application", glued=True),
    Hint(["http", "request"], "Web Server", "HTTP request log", "web"),
    Hint(["https", "request"], "Web Server", "HTTPS request log", "web"),
    Hint(["http", "error"], "Web Server", "HTTP error log", "web"),
    Hint(["https", "error"], "Web Server", "HTTPS error log", "web"),
    Hint(["ssl", "request"], "Web Server", "SSL request log", "web"),
    Hint(["ora"], "Oracle", "Oracle", "database", glued=True),
    Hint(["ssm", "agent"], "AWS", "Systems Manager Agent", "cloud_management"),
    Hint(["foreman"], "Red Hat", "Foreman/Katello", "management"),
    Hint(["aemcdn"], "Adobe", "Experience Manager CDN", "web_firewall"),
    Hint(["stream", "dns"], "Splunk", "Stream (wire data)", "dns"),
    Hint(["sysmon", "deploy"], "Splunk", "Sysmon deployment log", "management"),
    Hint(["datadiode"], "Data Diode", "Data diode", "network", glued=True),
    Hint(["netbackup"], "Veritas", "NetBackup", "backup", glued=True),
    Hint(["event", "viewer"], "Microsoft", "Windows Event Viewer", "windows"),
]
#: What the rest of a glued token must contain, for short beginnings.
GLUED_REST = {"ora": ["audit", "aud", "listener", "alert", "trace", "log", "apx", "apex", "ios", "db", "sql", "net", "tns"]}
FORMAT_TOKENS = [
    "syslog", "cef", "leef", "json", "xml", "kv", "kvp", "raw", "log", "logs", "estreamer", "operational", "rfc3164",
    "rfc5424", "nopri", "tcp", "udp",
]
JSON_SIGNATURES = {
    "o365_management_activity": ["RecordType", "CreationTime", "Operation", "OrganizationId", "Workload", "UserKey", "UserType"],
    "checkpoint_firewall": ["loguid", "originsicname"],
}
WINDOWS_EVENT = r"<Event\s+xmlns=['\"]http://schemas\.microsoft\.com/win/2004/08/events/event['\"]"
WINDOWS_CHANNELS = {
    "security": "windows_security",
    "microsoft-windows-ntlm/operational": "windows_security",
    "system": "windows_system",
    "application": "windows_application",
    "microsoft-windows-sysmon/operational": "windows_sysmon",
    "microsoft-windows-powershell/operational": "windows_powershell",
    "windows powershell": "windows_powershell",
    "microsoft-windows-windows defender/operational": "windows_defender",
    "microsoft-windows-dns-client/operational": "windows_dns_client",
}
