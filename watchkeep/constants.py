"""Results depend on these exact words, numbers and tables."""

SEVERITIES = ["critical", "high", "medium", "low", "info"]
NOTIFY_SEVERITIES = ["critical", "high"]

LOG_SOURCES = [
    "windows_event", "linux_syslog", "firewall", "ids_ips",
    "web_server", "auth_log", "dns", "netflow", "endpoint",
]

INCIDENT_STATUSES = ["open", "investigating", "contained", "resolved", "closed"]
LEGAL_STEPS = {
    "open": ["investigating", "closed"],
    "investigating": ["contained", "resolved", "open"],
    "contained": ["resolved", "investigating"],
    "resolved": ["closed", "investigating"],
    "closed": [],
}

# Brute force
FAILED_LOGON_TYPES = ["failed_logon_attempt", "ssh_failed_login"]
FAILED_LOGON_ID = 4625
FAILED_LOGON_TEXT = "Failed password"
BRUTE_FORCE_SECONDS, BRUTE_FORCE_COUNT = 120, 10

# Port scan
BLOCKED_ACTIONS = ["DENY", "DROP"]
PORT_SCAN_SECONDS, PORT_SCAN_PORTS = 60, 20

# Privilege escalation
PRIVILEGE_IDS = [4728, 4672, 4720, 4732, 4756]
PRIVILEGE_PHRASES = [
    "domain admins", "enterprise admins", "schema admins",
    "privilege escalation", "added to", "special privileges",
]

# PowerShell
POWERSHELL_PROCESSES = ["powershell.exe", "pwsh.exe"]
POWERSHELL_PATTERNS = [
    "-encodedcommand", "-enc ", "-nop ", "-noprofile",
    "downloadstring", "downloadfile", "iex(", "invoke-expression",
    "hidden", "-exec bypass", "webclient", "net.webclient",
    "system.net.sockets.tcpclient", "mimikatz", "invoke-mimikatz",
    "invoke-bloodhound", "sharphound", "powersploit", "empire",
    "cobalt", "meterpreter",
]

# Exfiltration
EXFILTRATION_BYTES = 10_000_000

# Malware
MALWARE_PROCESSES = [
    "mimikatz.exe", "cobalt_beacon.exe", "meterpreter.exe",
    "ransomware_dropper.exe", "keylogger.exe", "empire.exe",
    "sharphound.exe", "bloodhound.exe", "rubeus.exe",
]
MALWARE_PHRASES = [
    "cobalt strike", "meterpreter", "mimikatz", "ransomware",
    "et malware", "et trojan", "reverse shell", "malware execution",
]

# Beaconing
BEACON_SOURCES = ["firewall", "netflow", "ids_ips"]
INTERNAL_PREFIXES = ["192.168.", "10."]
BEACON_SECONDS, BEACON_COUNT = 300, 8

# Threat feed
FEED_IPS = [
    "185.220.101.47", "45.141.84.80", "194.165.16.11", "91.108.4.0",
    "185.220.100.255", "199.195.250.77", "192.42.116.16", "162.247.74.201",
    "104.244.74.55", "185.107.47.215",
]
FEED_HASHES = [
    "d41d8cd98f00b204e9800998ecf8427e",
    "5d41402abc4b2a76b9719d911017c592",
    "098f6bcd4621d373cade4e832627b4f6",
    "aab3238922bcc25a6f606eb525ffdc56",
    "9a0364b9e99bb480dd25e1f0284c8555",
]

# Technique to tactic
TACTICS = {
    "T1046": "Discovery",
    "T1078": "Initial Access",
    "T1110": "Credential Access",
    "T1059": "Execution",
    "T1055": "Defense Evasion",
    "T1041": "Exfiltration",
    "T1071": "Command & Control",
    "T1190": "Initial Access",
    "T1486": "Impact",
    "T1098": "Persistence",
    "T1134": "Privilege Escalation",
    "T1027": "Defense Evasion",
    "T1140": "Defense Evasion",
    "T1021": "Lateral Movement",
    "T1210": "Lateral Movement",
    "T1498": "Impact",
    "T1566": "Initial Access",
}

# Host event id: description, severity, techniques
HOST_EVENTS = {
    4624: ("Successful Logon", "info", []),
    4625: ("Failed Logon Attempt", "medium", ["T1110", "T1078"]),
    4648: ("Logon With Explicit Credentials", "medium", ["T1078"]),
    4672: ("Special Privileges Assigned", "high", ["T1078.002", "T1134"]),
    4688: ("New Process Created", "low", ["T1059", "T1106"]),
    4698: ("Scheduled Task Created", "medium", ["T1053.005"]),
    4720: ("User Account Created", "high", ["T1136"]),
    4728: ("User Added to Privileged Group", "critical", ["T1098"]),
    4768: ("Kerberos Authentication", "info", []),
    4776: ("NTLM Authentication", "low", []),
    7045: ("New Service Installed", "high", ["T1543.003"]),
    1102: ("Audit Log Cleared", "critical", ["T1070.001"]),
}

# Intrusion signature: severity, techniques
SIGNATURES = {
    "ET SCAN Nmap Scripting Engine": ("medium", ["T1046"]),
    "ET EXPLOIT MS17-010 EternalBlue": ("critical", ["T1210"]),
    "ET MALWARE Cobalt Strike Beacon": ("critical", ["T1071.001", "T1055"]),
    "ET POLICY Telnet Attempt": ("low", ["T1021"]),
    "ET SCAN Port Sweep": ("medium", ["T1046"]),
    "ET TROJAN Metasploit Meterpreter": ("critical", ["T1059", "T1071"]),
    "ET WEB_SERVER SQL Injection Attempt": ("high", ["T1190", "T1505.003"]),
    "ET MALWARE Ransomware Activity": ("critical", ["T1486"]),
    "ET CURRENT_EVENTS Phishing Kit": ("high", ["T1566"]),
    "ET DOS ICMP Flood": ("high", ["T1498"]),
}

# Web paths that force severity high
SENSITIVE_PATHS = ["/.env", "/../../../etc/passwd", "/api/admin/reset"]

# Country to map position (x, y)
COUNTRY_POSITIONS = {
    "Russia": (72, 22),
    "China": (79, 35),
    "United States": (20, 35),
    "Germany": (52, 28),
    "Netherlands": (51, 26),
    "Brazil": (28, 60),
    "Iran": (63, 36),
    "North Korea": (82, 30),
    "Romania": (55, 28),
    "Ukraine": (57, 27),
    "India": (71, 43),
    "United Kingdom": (49, 24),
    "France": (50, 28),
    "Canada": (18, 22),
    "Australia": (83, 72),
    "Unknown": (50, 50),
}

# Behaviour
RISK_HISTORY = 1000
DEFAULT_RISK = 20
DEFAULT_ANOMALY = 0.1
RISK_FLAG = 60
SURGE_FACTOR = 3
RISK_BANDS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]
INDICATOR_BANDS = [(75, "critical"), (50, "medium"), (25, "low")]

# Isolation forest
FOREST_TREES, FOREST_SEED, FOREST_CONTAMINATION = 100, 42, 0.05
ANOMALY_THRESHOLD = 0.6
