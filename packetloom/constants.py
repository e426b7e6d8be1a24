"""Thresholds, word lists, catalogues and name tables.

They are part of the result contract, so they are stated as plain text in
their natural order and must not be changed.
"""

from __future__ import annotations

# --- Fixed values: labels -------------------------------------------------
BENIGN_LABELS = ["normal", "benign", "0"]

LABEL_COLUMN_CANDIDATES = [
    "Label", "label", "LABEL", "Class", "class", "Attack", "attack", "Target", "target", "y", "Y",
]

# File-name vocabularies, first match wins.
FLOOD_FILE_LABELS = [
    ("syn", "syn_flood"),
    ("udplag", "udplag_flood"),
    ("udp", "udp_flood"),
    ("ldap", "ldap_flood"),
    ("mssql", "mssql_flood"),
    ("netbios", "netbios_flood"),
    ("portmap", "portmap_flood"),
    ("dns", "dns_flood"),
    ("ntp", "ntp_flood"),
]
FLOOD_FILE_DEFAULT = "normal"

REPLAY_FILE_LABELS = [
    ("benign", "BENIGN"),
    ("normal", "BENIGN"),
    ("syn", "SYN"),
    ("udp", "UDP"),
    ("dns", "DNS"),
    ("ntp", "NTP"),
    ("ldap", "LDAP"),
    ("mssql", "MSSQL"),
    ("netbios", "NetBIOS"),
    ("portmap", "Portmap"),
]

# --- Fixed values: rules --------------------------------------------------
RULE_THRESHOLDS = {
    "syn_flood_per_sec": 500.0,
    "udp_flood_per_min": 10000.0,
    "dns_flood_per_sec": 2000.0,
    "ntp_flood_per_min": 5000.0,
    "sql_injection_min_matches": 2.0,
    "pkt_anomaly_per_sec": 10000.0,
}

SQL_KEYWORDS = [
    "union", "select", "or 1=1", "drop", "insert", "update", "delete",
    "--", ";", "/*", "*/", "xp_cmdshell", "information_schema",
]

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

TINY_PACKET_BYTES = 100.0

RATE_FEATURES = ["pkt_rate", "syn_rate", "udp_rate", "dns_rate", "ntp_rate", "avg_pkt_size"]

# --- Fixed values: fusion and severity ------------------------------------
RULE_WEIGHT = 0.4
MODEL_WEIGHT = 0.6
FUSION_THRESHOLD = 0.5

EVENT_SEVERITY_CUTS = [(0.95, "critical"), (0.8, "high"), (0.6, "medium")]
EXPLANATION_SEVERITY_CUTS = [(0.85, "critical"), (0.65, "high"), (0.45, "medium")]

MAX_ABS_INPUT = 1e12

# --- Fixed values: metric aliases -----------------------------------------
METRIC_ALIASES = {
    "pkt_len": [
        "pkt_len", "packet_length", "packet_len", "avg_pkt_size", "avg_packet_size",
        "packet_length_mean", "packet length mean", "average packet size", "fwd packet length mean",
    ],
    "syn_count": [
        "syn_count", "syn_rate", "syn_packets_per_sec", "syn per sec",
        "syn flag count", "syn_flag_count", "synflagcount",
    ],
    "udp_count": [
        "udp_count", "udp_rate", "udp_packets_per_min", "udp per min",
        "udp packet count", "udp packets per min",
    ],
}
SYN_RATE_ALIASES = ["syn_rate", "syn_packets_per_sec", "syn per sec"]

# --- Fixed values: explanation catalogue ----------------------------------
ATTACK_CATALOGUE = {
    "SYN_FLOOD": (
        "SYN Flood", "大量SYN请求但不完成握手，耗尽服务连接资源。", "high",
        ["启用SYN Cookie并调整半连接队列。", "在边界设备配置SYN速率限制。", "对可疑源地址启用ACL或黑洞路由。"],
    ),
    "UDP_FLOOD": (
        "UDP Flood", "高强度UDP流量导致带宽或CPU资源被挤占。", "high",
        ["限制高风险UDP端口的速率。", "关闭非必要UDP服务。", "接入流量清洗能力。"],
    ),
    "DNS_FLOOD": (
        "DNS Flood", "针对DNS服务的大量查询压垮解析能力。", "high",
        ["启用DNS响应速率限制(RRL)。", "部署多节点DNS与缓存策略。", "对异常源IP实施限流和封禁。"],
    ),
    "NTP_FLOOD": (
        "NTP Flood", "利用NTP协议进行高流量放大或反射攻击。", "medium",
        ["限制NTP外部访问并关闭monlist等高风险能力。", "升级NTP服务并启用访问控制。", "过滤来源异常的NTP响应流量。"],
    ),
    "SQL_INJECTION": (
        "SQL Injection", "请求载荷疑似包含恶意SQL语句注入模式。", "critical",
        ["全面使用参数化查询。", "加强输入校验和输出转义。", "部署WAF并审计高风险接口。"],
    ),
    "DDOS": (
        "DDoS", "流量统计出现异常洪泛行为。", "high",
        ["启用弹性防护与自动扩容策略。", "配置全链路限流与熔断。", "建立应急响应预案和回放机制。"],
    ),
    "NORMAL": (
        "Normal", "未发现明确攻击证据。", "low",
        ["保持监控并定期更新检测规则与模型。"],
    ),
}
VERIFY_ADVICE = "建议结合上下文流量进一步确认，降低误报风险。"
NORMAL_SUMMARY = "当前样本未命中攻击规则，模型也未给出攻击判定。"
DETECTED_SUMMARY = ("检测到 ", "，置信度 ", "。")
RULE_DETAIL_TITLE = "规则触发证据:"
MODEL_DETAIL_TITLE = "模型判定: "
FEATURE_DETAIL_TITLE = "关键流量特征:"
NO_DETAIL = "无额外可解释证据。"

# --- Fixed values: knowledge base (name, description, harm, defense) -------
ATTACK_KNOWLEDGE = {
    "normal": (
        "正常流量",
        "网络流量行为符合常规业务访问模型，未检测到异常发包行为、扫描行为或攻击特征，属于合法合规的网络通信。",
        "无安全威胁，业务运行稳定。",
        "保持常规流量监控，定期巡检异常连接行为即可。",
    ),
    "synflood": (
        "SYN Flood 拒绝服务攻击",
        "攻击者通过发送大量伪造 TCP 连接请求（SYN 包），使目标服务器维持大量半开放连接，耗尽连接资源与内核资源，最终无法响应正常用户请求。",
        "服务器端口耗尽、服务不可用、业务中断、系统负载异常升高，严重影响网络可用性。",
        "启用 SYN Cookie 防护、限制单 IP 并发连接数、配置防火墙限流策略、开启流量清洗、拉黑攻击源 IP。",
    ),
    "udpflood": (
        "UDP Flood 流量攻击",
        "攻击者向目标主机或端口发送海量伪造 UDP 数据包，占用网络出口带宽，造成网络拥塞，使正常数据包无法正常传输。",
        "出口带宽被占满、业务延迟剧增、丢包率上升、服务响应缓慢甚至瘫痪。",
        "配置 UDP 报文速率限制、过滤无效 UDP 包、启用流量清洗、限制单 IP 发包速率、高防 IP 防护。",
    ),
    "dnsflood": (
        "DNS Flood 域名解析攻击",
        "攻击者通过向 DNS 服务器发送大量伪造解析请求，耗尽服务器计算与 I/O 资源，导致 DNS 服务无法正常响应合法域名查询。",
        "域名解析失败、业务无法访问、系统瘫痪、影响大范围用户连接。",
        "启用 DNS 请求限速、开启 DNS 验证、配置 Anycast、部署高防 DNS、过滤异常请求源。",
    ),
    "ntpflood": (
        "NTP 放大攻击",
        "攻击者利用公开 NTP 服务器的 monlist 功能发起反射放大攻击，通过极小请求流量产生巨大响应流量，形成高带宽攻击。",
        "目标带宽瞬间被打满、网络阻塞、链路拥塞、设备瘫痪。",
        "关闭 NTP 服务器放大功能、限制 NTP 服务访问源、配置流量清洗、启用黑洞路由。",
    ),
    "portscan": (
        "端口扫描探测行为",
        "攻击者通过对目标主机进行端口探测，识别开放端口、运行服务与系统版本，收集可攻击面信息，属于典型入侵前侦察行为。",
        "服务器敏感信息泄露、服务版本暴露、漏洞面扩大，易引发后续暴力破解与漏洞利用。",
        "关闭无用端口、配置防火墙端口访问策略、限制扫描频率、启用入侵检测、记录扫描源 IP。",
    ),
    "ddos": (
        "DDoS 分布式拒绝服务攻击",
        "由多节点控制肉鸡共同发起流量型/资源耗尽型攻击，通过大规模并发请求冲击目标服务，使其无法对外提供正常功能。",
        "服务全面中断、业务完全不可用、经济损失高、恢复难度大。",
        "部署高防 IP、流量清洗、黑洞路由、CDN 加速、限制异常流量、多层防护架构。",
    ),
    "unknown": (
        "未知异常流量",
        "系统检测到流量行为异常，但无法匹配已知攻击特征库，可能为新型攻击、变异攻击或异常业务流量。",
        "存在潜在安全风险，可能导致未定义的系统威胁与服务影响。",
        "加强流量日志记录、提升检测级别、对异常源 IP 临时封禁、进一步分析流量特征、更新威胁库。",
    ),
}
NO_INDICATORS = "暂无特定技术指标"

# --- Fixed values: ports --------------------------------------------------
HIGH_RISK_PORTS = {
    21: "FTP", 23: "Telnet", 25: "SMTP", 135: "RPC", 139: "NetBIOS",
    445: "SMB", 3306: "MySQL", 3389: "RDP", 6379: "Redis",
}
SERVICE_NAMES = {
    21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 110: "pop3", 135: "rpc",
    139: "netbios", 143: "imap", 443: "https", 445: "smb", 3306: "mysql", 3389: "rdp",
    6379: "redis", 8080: "http-alt",
}
ADVICE_LIMIT_EXPOSURE = "Limit exposure of high-risk ports with ACL, firewall, or zero-trust policy."
ADVICE_STRONG_AUTH = "Enable MFA and strong auth for management services (SSH/RDP/DB)."
ADVICE_REVIEW_PORTS = "Review open ports and close services not required by business."
ADVICE_KEEP_CHECKING = "No open ports detected in current scan scope; keep periodic active checks."
ADVICE_RETRY = "Some targets returned probe errors; retry with approved network path and timeout."

# --- Fixed values: client address headers, alerts, envelope ----------------
CLIENT_IP_HEADERS = [
    "cf-connecting-ip", "true-client-ip", "x-forwarded-for", "x-real-ip",
    "x-client-ip", "x-original-forwarded-for", "forwarded",
]
GEO_PROVIDER = "ip_ranges"

ALERT_TEMPLATES = {
    "detection": (
        "[安全告警]\n时间: {timestamp}\n攻击类型: {attack_type}\n严重度: {severity}\n"
        "置信度: {confidence:.4f}\n来源: {source}\n输入类型: {input_kind}\n摘要: {summary}\n"
    ),
    "batch": (
        "[批量告警]\n时间: {timestamp}\n总事件: {total_events}\n攻击事件: {attack_events}\n"
        "正常事件: {benign_events}\n攻击比例: {attack_ratio:.2%}\n"
    ),
}
DEFAULT_ALERT_SUMMARY = "检测到疑似攻击流量"

CSV_ENVELOPE_PREFIX = "CSV_CONTENT:"

# --- Fixed values: TCP flag masks -----------------------------------------
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwe": 128}

# --- Fixed values: special-purpose address registries ----------------------
# Address blocks that are not globally reachable (IANA special registries, IPv4).
NON_PUBLIC_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
NON_PUBLIC_V6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "100::/64", "2001::/23", "2001:2::/48", "2001:db8::/32",
    "2001:10::/28", "fc00::/7", "fe80::/10",
]
