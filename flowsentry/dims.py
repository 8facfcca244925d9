"""Ports, names, texts and thresholds that decide results.

Everything in this file is a constant of the domain.  Operators take the
thresholds as keyword arguments whose defaults are the values below.
"""

# ---- Fixed values: protocols -------------------------------------------------
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}

# TCP flag letters, lowest bit first (FIN, SYN, RST, PSH, ACK, URG, ECE, CWR).
TCP_FLAGS = "FSRPAUEC"

# ---- Fixed values: flow profile ports ---------------------------------------
FLOW_BAD_PORTS = [31337, 4444, 1337, 6666, 6667, 6668, 12345, 54321, 27374, 3128, 8080, 9050]
FLOW_SENSITIVE_PORTS = [22, 23, 3389, 5900, 445, 139, 135]

# ---- Fixed values: capture profile ports ------------------------------------
CAPTURE_BAD_PORTS = {
    4444: "Metasploit/Meterpreter C2",
    1337: "Leet/C2 backdoor",
    31337: "Back Orifice RAT",
    6666: "IRC botnet C2",
    6667: "IRC botnet C2",
    12345: "NetBus RAT",
    54321: "Back Orifice",
    27374: "SubSeven RAT",
    9050: "Tor proxy",
    8080: "HTTP proxy/C2",
    3128: "Squid proxy abuse",
}
CAPTURE_SENSITIVE_PORTS = {
    22: "SSH",
    23: "Telnet",
    3389: "RDP",
    5900: "VNC",
    445: "SMB",
    139: "NetBIOS",
    135: "DCOM RPC",
    21: "FTP",
}

# ---- Fixed values: severity ---------------------------------------------------
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_COLORS = {"LOW": "#36a64f", "MEDIUM": "#f4bf00", "HIGH": "#d9534f", "CRITICAL": "#7b1a1a"}

# ---- Fixed values: flow signatures (rule, severity, tactic, technique) -------
# Order is the evaluation order; it settles ties between equal severities.
SIGNATURES = [
    ("KNOWN_MALICIOUS_PORT", "HIGH", "Command and Control", "T1071"),
    ("PORT_SCAN", "HIGH", "Reconnaissance", "T1046"),
    ("SYN_FLOOD", "CRITICAL", "Impact", "T1499"),
    ("ICMP_FLOOD", "HIGH", "Impact", "T1498"),
    ("DNS_AMPLIFICATION", "HIGH", "Impact", "T1498.002"),
    ("SENSITIVE_PORT_ACCESS", "MEDIUM", "Initial Access", "T1190"),
]

# ---- Fixed values: host event labels ------------------------------------------
HOST_TACTICS = {
    "AUTH_FAIL": "Credential Access",
    "BRUTE_FORCE": "Credential Access",
    "AUTH_SUCCESS": "Initial Access",
    "SUDO": "Privilege Escalation",
    "SUDO_FAIL": "Privilege Escalation",
    "USER_ADDED": "Persistence",
    "USER_DELETED": "Impact",
    "FILE_CHANGE": "Persistence",
    "MODIFIED": "Persistence",
    "CREATED": "Persistence",
    "DELETED": "Impact",
    "SUSPICIOUS_SPAWN": "Execution",
    "SUSPICIOUS_PROCESS": "Execution",
}
HOST_TECHNIQUES = {
    "AUTH_FAIL": "T1110",
    "BRUTE_FORCE": "T1110.001",
    "SUDO": "T1548.003",
    "USER_ADDED": "T1136",
    "FILE_CHANGE": "T1565",
    "SUSPICIOUS_SPAWN": "T1059",
}

# ---- Fixed values: MITRE ATT&CK reference table --------------------------------
MITRE = [
    ("PORT_SCAN", "Reconnaissance", "T1046", "Network Service Discovery"),
    ("KNOWN_BAD_IP", "Initial Access", "T1133", "External Remote Services"),
    ("SQL_INJECTION", "Initial Access", "T1190", "Exploit Public-Facing Application"),
    ("SYN_FLOOD", "Impact", "T1498.001", "Direct Network Flood"),
    ("DATA_EXFILTRATION", "Exfiltration", "T1041", "Exfiltration Over C2 Channel"),
    ("LATERAL_MOVEMENT", "Lateral Movement", "T1021.002", "SMB/Windows Admin Shares"),
    ("HIGH_RISK_PORT_ACCESS", "Lateral Movement", "T1021", "Remote Services"),
    ("SSH_BRUTE_FORCE", "Credential Access", "T1110.001", "Password Guessing"),
    ("AUTH_FAIL", "Credential Access", "T1110", "Brute Force"),
    ("PASSWD_CHANGE", "Credential Access", "T1098", "Account Manipulation"),
    ("FILE_MODIFIED", "Defense Evasion", "T1565.001", "Stored Data Manipulation"),
    ("FILE_DELETED", "Defense Evasion", "T1070", "Indicator Removal"),
    ("PERMISSION_CHANGE", "Defense Evasion", "T1222", "File Permissions Modification"),
    ("NEW_USER", "Persistence", "T1136", "Create Account"),
    ("FILE_CREATED", "Persistence", "T1543", "Create or Modify System Process"),
    ("SUSPICIOUS_PROCESS", "Execution", "T1059", "Command and Scripting Interpreter"),
    ("PRIVILEGE_ESCALATION_ATTEMPT", "Privilege Escalation", "T1068", "Exploitation for Privilege Escalation"),
]

MITRE_TACTICS = {kind: tactic for kind, tactic, _, _ in MITRE}
MITRE_TECHNIQUES = {kind: technique for kind, _, technique, _ in MITRE}

# ---- Fixed values: auth log, engine profile ------------------------------------
# (rule, pattern after the header, event type, severity); first match wins.
# Groups of the whole pattern: 1 time, 2 host, 3 pid, 4 user, 5 address or command.
AUTH_HEADER = r"(\w+\s+\d+\s[\d:]+)\s(\S+)\s"
AUTH_RULES = [
    ("SSH_FAILED", r"\S+\[(\d+)\]:\sFailed\s\w+\sfor\s(?:invalid user\s)?(\S+)\sfrom\s([\d.]+)", "AUTH_FAIL", "MEDIUM"),
    ("SSH_SUCCESS", r"\S+\[(\d+)\]:\sAccepted\s\w+\sfor\s(\S+)\sfrom\s([\d.]+)", "AUTH_SUCCESS", "LOW"),
    ("SUDO_SUCCESS", r"sudo\[(\d+)\]:\s+(\S+)\s.*COMMAND=(.*)", "SUDO", "MEDIUM"),
    ("SUDO_FAIL", r"sudo\[(\d+)\]:\s+(\S+)\s.*(?:incorrect password|authentication failure)", "SUDO_FAIL", "HIGH"),
    ("USER_ADDED", r"useradd\[(\d+)\]:\snew user:\sname=(\S+)", "USER_ADDED", "HIGH"),
    ("USER_DELETED", r"userdel\[(\d+)\]:\sdelete user '(\S+)'", "USER_DELETED", "HIGH"),
]

# Text every match of a rule's pattern contains; a cheap test before the pattern.
AUTH_MARKS = {
    "SSH_FAILED": "Failed",
    "SSH_SUCCESS": "Accepted",
    "SUDO_SUCCESS": "COMMAND=",
    "SUDO_FAIL": "sudo",
    "USER_ADDED": "useradd",
    "USER_DELETED": "userdel",
}

# ---- Fixed values: log lines, upload profile -----------------------------------
# (pattern, event type, severity, group of user, group of address); 0 = no group.
UPLOAD_RULES = [
    (r"Failed password for (?:invalid user )?(\S+) from ([\d.]+)", "SSH_FAIL", "MEDIUM", 1, 2),
    (r"Accepted password for (\S+) from ([\d.]+)", "SSH_SUCCESS", "LOW", 1, 2),
    (r"Accepted publickey for (\S+) from ([\d.]+)", "SSH_PUBKEY", "LOW", 1, 2),
    (r"sudo:\s+(\S+).+COMMAND=(.*)", "SUDO_EXEC", "HIGH", 1, 2),
    (r"useradd.*name=(\S+)", "USER_CREATE", "HIGH", 1, 0),
    (r"userdel.*name=(\S+)", "USER_DELETE", "HIGH", 1, 0),
    (r"Invalid user (\S+) from ([\d.]+)", "INVALID_USER", "MEDIUM", 1, 2),
    (r"authentication failure.*user=(\S+)", "AUTH_FAIL", "MEDIUM", 1, 0),
    (r"BREAK-IN ATTEMPT.*from ([\d.]+)", "BREAK_IN", "CRITICAL", 0, 1),
    (r"([\d.]+).*refused connect", "REFUSED_CONN", "LOW", 0, 1),
    (r"pam_unix.*auth.*failure.*ruser=(\S+)", "PAM_FAIL", "MEDIUM", 1, 0),
    (r"segfault", "SEGFAULT", "MEDIUM", 0, 0),
    (r"kernel.*oom", "OOM_KILL", "LOW", 0, 0),
]
# Lower-case text every match of a rule's pattern contains.
UPLOAD_MARKS = {
    "SSH_FAIL": "failed password for ",
    "SSH_SUCCESS": "accepted password for ",
    "SSH_PUBKEY": "accepted publickey for ",
    "SUDO_EXEC": "sudo:",
    "USER_CREATE": "useradd",
    "USER_DELETE": "userdel",
    "INVALID_USER": "invalid user ",
    "AUTH_FAIL": "authentication failure",
    "BREAK_IN": "break-in attempt",
    "REFUSED_CONN": "refused connect",
    "PAM_FAIL": "pam_unix",
    "SEGFAULT": "segfault",
    "OOM_KILL": "oom",
}
UPLOAD_TIME = r"^(\w{3}\s+\d+\s+\d+:\d+:\d+)"
UPLOAD_MINUTE = r"(\d+:\d+):\d+"
NO_VALUE = "—"

# ---- Fixed values: files and processes ------------------------------------------
CRITICAL_PATHS = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/hosts", "/bin/", "/usr/bin/", "/sbin/"]
SHELLS = ["bash", "sh", "zsh", "fish", "dash", "ksh", "tcsh", "csh"]
WEB_PARENTS = ["nginx", "apache2", "httpd", "php-fpm", "node", "java", "ruby"]
SUSPICIOUS_NAMES = [
    "nc", "ncat", "netcat", "nmap", "masscan",
    "mimikatz", "msfconsole", "msfvenom",
    "cryptominer", "xmrig",
]
REVERSE_SHELL_MARKS = ["/dev/tcp/", "bash -i", "nc -e", "mkfifo"]

# ---- Fixed values: features -------------------------------------------------------
FEATURES = [
    "duration_ms", "total_packets", "total_bytes",
    "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
    "pkt_rate", "byte_rate", "fwd_bwd_ratio", "avg_pkt_size",
    "has_syn", "has_fin", "has_rst",
    "dst_port_well_known", "dst_port_registered", "dst_port_ephemeral", "src_port_privileged",
    "is_tcp", "is_udp", "is_icmp",
    "log_total_bytes", "log_pkt_rate", "log_byte_rate",
]

# ---- Fixed values: model ensemble ---------------------------------------------------
MODEL_WEIGHTS = {"if": 0.25, "rf": 0.50, "ae": 0.25}
VOTE_THRESHOLDS = {"if": 0.7, "rf": 0.8, "ae": 0.85}
VOTES_NEEDED = 2
CONFIDENCE_BANDS = [(0.90, "CRITICAL"), (0.75, "HIGH"), (0.55, "MEDIUM")]
BENIGN = "BENIGN"

# ---- Fixed values: login forms and account names -------------------------------------
LOGIN_FIELDS = ["username", "user", "login", "uid", "email"]
KERBEROS_SKIP = ["anonymous", "guest", "null", "krbtgt"]
