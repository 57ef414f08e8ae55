"""Layouts of vendors' lines, on lines made up here."""

import pytest

from maskline.operators import vendors

LINES = {
    "cisco_asa": [
        (
            "Jan  2 2024 03:04:05 fw1 : %ASA-6-302013: Built inbound TCP connection 77 for outside:10.1.1.1/4000 (10.1.1.1/4000) to inside:10.2.2.2/443 (10.2.2.2/443)",
            {"host": "fw1", "severity": "6", "event_code": "302013", "action": "Built", "src_ip": "10.1.1.1", "src_port": "4000", "dest_ip": "10.2.2.2", "dest_port": "443", "src_interface": "outside"},
        ),
        ("%FTD-5-611103: User logged out: Uname: x user = ann", {"event_code": "611103", "device": "FTD"}),
        ("other", {}),
    ],
    "fortinet_fortigate": [
        ('date=2024-01-02 devname="fw 1" srcip=10.1.1.1 dstip=10.2.2.2 dstport=443 action="deny" policyid=7', {"src_ip": "10.1.1.1", "dest_ip": "10.2.2.2", "dest_port": "443", "host": "fw 1", "policy_id": "7"}),
        ("CEF:0|F|G|1|2|n|5|src=10.1.1.1 FTNTFGTlevel=high alert FTNTFGTsubtype=x", {"src_ip": "10.1.1.1", "severity": "high alert", "subtype": "x"}),
    ],
    "infoblox_dns": [
        ("<30>Jan  2 03:04:05 ns1 named[5]: client 10.1.1.1#53 (a.b): UDP: query: a.b IN AAAA response: NXDOMAIN +", {"host": "ns1", "src_ip": "10.1.1.1", "query": "a.b", "query_type": "AAAA", "event_code": "NXDOMAIN"}),
        ("Jan  2 03:04:05 ns1 dhcpd[5]: DHCPREQUEST for 10.1.1.9 from 00:1b:44:11:3a:b7 (pc7) via eth0", {"dest_ip": "10.1.1.9", "src_mac": "00:1b:44:11:3a:b7", "src_host": "pc7", "event_code": "DHCPREQUEST"}),
    ],
    "juniper_srx": [
        (
            '<14>1 2024-01-02T03:04:05Z srx1 RT_FLOW - RT_FLOW_SESSION_DENY [x source-address="10.1.1.1" source-port="4" destination-address="10.2.2.2" destination-port="80" protocol-name="tcp" policy-name="p 1"]',
            {"host": "srx1", "src_ip": "10.1.1.1", "dest_port": "80", "transport": "tcp", "action": "p 1"},
        )
    ],
    "linux_secure": [
        ("Jan  2 03:04:05 web1 sshd[9]: Failed password for invalid user ann from 10.1.1.1 port 4000 ssh2", {"host": "web1", "pid": "9", "action": "Failed", "user": "ann", "src_ip": "10.1.1.1", "app": "sshd"}),
        ("Jan  2 03:04:05 web1 sudo: ann : TTY=pts/0 ; PWD=/x ; USER=root ; COMMAND=/bin/ls -l", {"user": "ann", "runas_user": "root", "command": "/bin/ls -l"}),
        ("Jan  2 03:04:05 web1 su: session opened for user ann(uid=1)", {"user": "ann"}),
    ],
    "linux_syslog": [
        ("Jan  2 03:04:05 web1 kernel: [UFW BLOCK] IN=e OUT= SRC=10.1.1.1 DST=10.2.2.2 LEN=4 PROTO=TCP SPT=5 DPT=6 W=1", {"action": "BLOCK", "src_ip": "10.1.1.1", "dest_port": "6", "transport": "TCP"})
    ],
    "pfsense": [
        ("<134>Jan  2 03:04:05 filterlog[7]: 5,,,100,igb0,match,block,in,4,0x0,,64,1,0,DF,6,tcp,60,10.1.1.1,10.2.2.2,5,6,0", {"action": "block", "direction": "in", "transport": "tcp", "src_ip": "10.1.1.1", "dest_port": "6"}),
        ("<134>1 2024-01-02T03:04:05Z gw filterlog 7 - 5,,,1,i,match,pass,out,4,0x0,,64,1,0,DF,17,udp,60,10.1.1.1,10.2.2.2,5,6,0", {"host": "gw", "action": "pass", "transport": "udp"}),
    ],
    "vsphere": [("<14>1 2024-01-02T03:04:05Z vc1 vpxd 88 - - [ok] done", {"host": "vc1", "app": "vpxd", "pid": "88", "dest": "vc1"})],
    "cef": [
        (
            "<134>Jan  2 03:04:05 gw1 CEF:0|Acme|Gate \\| X|1.0|77|Login failed|High|src=10.1.1.1 spt=4000 suser=ann cs1Label=Rule Name cs1=deny all cn1Label=a\\=b cn1=5 rt=1700000000000",
            {
                "vendor": "Acme", "event_code": "77", "signature": "Login failed", "severity": "8", "src_ip": "10.1.1.1", "src_port": "4000", "user": "ann",
                "Rule_Name": "deny all", "a_b": "5", "host": "gw1", "log_time": "1700000000000", "syslog_pri": "134",
            },
        ),
        ('"CEF:0|Acme|Gate|1|7|n|3|dst=10.2.2.2 in=7"', {"dest_ip": "10.2.2.2", "bytes_in": "7", "severity": "3", "vendor_product": "Acme Gate"}),
        ("plain", {}),
    ],
    "checkpoint_firewall": [
        (
            '<134>1 2024-01-02T03:04:05Z gw1 CheckPoint 7 - [action:"Accept"; src:"10.1.1.1"; dst:"10.2.2.2 (host)"; service:"443"; proto:"6"; loguid:"{0x1,0x2}"; rule_name:"Out; all"]',
            {"action": "Accept", "src_ip": "10.1.1.1", "dest_ip": "10.2.2.2", "dest_port": "443", "transport": "6", "session_id": "{0x1,0x2}", "rule": "Out; all", "host": "gw1", "severity": "6", "app": "Check Point Firewall"},
        ),
        ("time=1700000000|hostname=gw 1|product=VPN-1|action=Drop|src=10.1.1.1", {"log_time": "1700000000", "host": "gw 1", "action": "Drop", "src_ip": "10.1.1.1"}),
        ('Jan  2 03:04:05 gw1 action="Drop" src="10.1.1.1" xlatesrc="10.9.9.9"', {"log_time": "Jan  2 03:04:05", "host": "gw1", "src_ip": "10.1.1.1", "src_translated_ip": "10.9.9.9"}),
        ("CEF:0|Check Point|VPN-1|R81|Log|n|Low|src=10.1.1.1 origin=10.3.3.3 ifname=eth0 service_id=https", {"src_ip": "10.1.1.1", "origin_ip": "10.3.3.3", "src_zone": "eth0", "app": "https", "severity": "2"}),
        ('{"loguid":"u1","src":"10.1.1.1","origin":"10.3.3.3"}', {"session_id": "u1", "src_ip": "10.1.1.1", "origin_ip": "10.3.3.3"}),
        ("plain", {}),
    ],
    "cisco_esa": [
        ("Tue Jan  2 03:04:05 2024 Info: MID 12 ICID 7 From: <ann@a.example>", {"mid": "12", "icid": "7", "sender": "ann@a.example", "user": "ann@a.example", "severity": "Info"}),
        ("Tue Jan  2 03:04:05 2024 Info: MID 12 ICID 7 RID 0 To: <bob@b.example>", {"rid": "0", "recipient": "bob@b.example", "dest_user": "bob@b.example"}),
        ("Tue Jan  2 03:04:05 2024 Info: New SMTP ICID 7 interface Data (10.0.0.1) address 10.1.1.1 reverse dns host h.example verified yes", {"icid": "7", "src_ip": "10.1.1.1", "reverse_dns": "h.example", "dns_verified": "yes"}),
        ("plain", {}),
    ],
    "cisco_umbrella": [
        ('"2024-01-02 03:04:05","ann","ann,net","10.1.1.1","9.9.9.1","Allowed","1 (A)","NOERROR","a.example."', {"user": "ann", "src_ip": "10.1.1.1", "dns_query": "a.example.", "app": "DNS", "product": "Umbrella"}),
        ('2024-01-02 03:04:05","ann","10.1.1.1","9.9.9.1","9.9.9.2","text/html","ALLOWED","https://a.example/x"', {"dest_ip": "9.9.9.2", "url": "https://a.example/x", "app": "Proxy", "user": "ann"}),
        ("plain,line", {}),
    ],
    "f5_bigip": [
        (
            "<134>Jan  2 03:04:05 lb1 notice mcpd[77]: 01070638:5: Pool /Common/web member /Common/10.2.2.2:80 monitor status down.",
            {"host": "lb1", "severity": "notice", "process": "mcpd", "msg_id": "01070638:5", "pool": "/Common/web", "dest_ip": "10.2.2.2", "dest_port": "80", "action": "down"},
        ),
        (
            "Jan  2 03:04:05 lb1 notice tmsh[7]: AUDIT - pid=7354 user=root folder=/ module=(tmos)# status=[Command OK] cmd_data=list cm device",
            {"user": "root", "folder": "/", "status": "Command OK", "cmd_data": "list cm device", "process": "tmsh"},
        ),
        ("plain", {}),
    ],
    "salesforce_setupaudittrail": [
        ('{"Action":"changedProfile","Section":"Users","Display":"Changed x","CreatedById":"005","DelegateUser":null,"CreatedDate":"2022-08-16T09:26:38.000+0000"}', {"action": "changedProfile", "user": "005", "object": "Users", "outcome": "success", "severity": "5"}),
        ("plain", {}),
    ],
    "zscaler_web": [
        ("datetime=Tue Jan 2 03:04:05 2024\tlogin=ann@a.example\tClientIP=10.1.1.1\turl=a.example/x y\tresponsesize=12", {"log_time": "Tue Jan 2 03:04:05 2024", "user": "ann@a.example", "src_ip": "10.1.1.1", "url": "a.example/x y", "bytes_in": "12"}),
        ("CEF:0|Zscaler|NSSWeblog|5.7|Blocked|Bad category|3|src=10.1.1.1 dst=10.2.2.2 request=a.example", {"action": "Blocked", "reason": "Bad category", "src_ip": "10.1.1.1", "url": "a.example"}),
        ('{"sourcetype":"zscalernss-web","event":{"login":"ann","clientip":"10.1.1.1","status":"200"}}', {"user": "ann", "src_ip": "10.1.1.1", "http_status": "200", "vendor_product": "Zscaler ZIA"}),
        ("plain", {}),
    ],
    "zeek_conn": [('<1>Jan 2 zeek: {"id.orig_h":"10.1.1.1","id.resp_p":443,"uid":"C1","proto":"tcp"}', {"src_ip": "10.1.1.1", "dest_port": "443", "session_id": "C1", "transport": "tcp"})],
    "windows_security": [
        (
            "<Event xmlns='http://x'><System><Provider Name='Sec'/><EventID>4624</EventID><TimeCreated SystemTime='2024-01-02'/><Computer>pc1</Computer></System>"
            "<EventData><Data Name='TargetUserName'>ann</Data><Data Name='IpAddress'>10.1.1.1</Data></EventData></Event>",
            {"event_code": "4624", "host": "pc1", "user": "ann", "src_ip": "10.1.1.1", "provider": "Sec", "log_time": "2024-01-02"},
        )
    ],
}


@pytest.mark.parametrize("source", sorted(LINES))
def test_layout(spark, source):
    rows = spark.createDataFrame([("s", i, raw) for i, (raw, _) in enumerate(LINES[source])], "sample_id string, line_no long, raw string")
    got = {r.line_no: r.fields or {} for r in vendors.parsed(rows, source).collect()}
    for i, (_, want) in enumerate(LINES[source]):
        assert {k: got[i].get(k) for k in want} == want
        assert want or not got[i]


def test_small_checks(spark):
    from pyspark.sql import functions as F

    from maskline.operators import checks

    row = spark.createDataFrame([("<a b=\"c\">'&",)], "v string").select(checks.html_escaped(F.col("v")).alias("x"), checks.squash(F.lit("A-b_7")).alias("y")).first()
    assert row == ("&lt;a b=&quot;c&quot;&gt;&#39;&amp;", "ab7")
    entries = spark.createDataFrame([("b",), ("abc",), ("a",)], "original string")
    assert [r.original for r in checks.longest_first(entries).collect()] == ["abc", "a", "b"]


def test_times(spark):
    import datetime

    from pyspark.sql import functions as F

    from maskline.functions import times

    utc = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp())
    want = {
        "Jan  2 03:04:05": utc(2024, 1, 2, 3, 4, 5), "Dec 31 23:59:59": utc(2023, 12, 31, 23, 59, 59), "Jan  4 02:00:00": utc(2024, 1, 4, 2),
        "Feb 29 01:00:00": None, "02/Jan/2024:03:04:05 +0100": utc(2024, 1, 2, 2, 4, 5), "2024-01-02T03:04:05Z": utc(2024, 1, 2, 3, 4, 5),
        "2024-01-02 03:04:05": utc(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05.250+02:00": utc(2024, 1, 2, 1, 4, 5), "2022-08-16T09:26:38.000+0000": utc(2022, 8, 16, 9, 26, 38),
        "1700000000": 1_700_000_000, "1700000000123": 1_700_000_000, "1700000000.5": 1_700_000_000, "Tue Jan  2 03:04:05 2024": utc(2024, 1, 2, 3, 4, 5),
        "Jan  2 2024 03:04:05": utc(2024, 1, 2, 3, 4, 5), "": None, "never": None, "2024-13-45T99:00:00": None, "Jan 99 03:04:05": None, None: None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "v string")
    now = datetime.datetime(2024, 1, 3, 12)
    got = {r.v: r.t for r in rows.select("v", times.epoch(F.col("v"), now).alias("t")).collect()}
    assert got == want | {"Feb 29 01:00:00": None}
    lengths = {"0:00:07": 7, "12:34:56": 45296, "1h2m3s": 3723, "5m": 300, "45s": 45, "": None, "1x": None, None: None}
    rows = spark.createDataFrame([(x,) for x in lengths], "v string")
    assert {r.v: r.t for r in rows.select("v", times.seconds(F.col("v")).alias("t")).collect()} == lengths
    words = {"7": 7, "Very-High": 10, "high": 8, "odd": None, "": None, None: None}
    rows = spark.createDataFrame([(x,) for x in words], "v string")
    assert {r.v: r.t for r in rows.select("v", times.severity(F.col("v")).alias("t")).collect()} == words
