"""Fixed values stated once more, as the text of the SQL that checks them: a slip in the library's own shows as a difference."""

from __future__ import annotations

#: Flag -> (pattern, whether case counts).
FLAGS = {
    "has_download_execute_chain": (r"(?:wget|curl|tftp)\b.*(?:chmod|\.\\/|sh\s|bash\s|python)", False),
    "has_reverse_shell": (r"(?:/dev/tcp/|nc\b.*-e|bash\b.*-i\s*>&|mkfifo)", False),
    "has_base64_decode": (r"(?:base64\s+-d|echo\s+.*\|\s*base64)", False),
    "has_recon_commands": (r"\b(?:uname|whoami|id|ifconfig|ip\s+a|cat\s+/etc/passwd|hostname|netstat)\b", False),
    "has_persistence": (r"(?:crontab|\.bashrc|systemctl\s+enable|rc\.local)", False),
    "has_file_exfiltration": (r"(?:\bscp\b|\bcurl\b.*POST|\btar\b.*\|)", False),
    "has_destructive": (r"\b(?:rm\s+-rf|mkfs|dd\s+if=|killall)\b", False),
    "has_downloader": (r"\b(?:wget|curl|tftp|ftp|scp)\b", False),
    "has_sql_injection": (r"(?:union\s+select|sleep\(|or\s+1\s*=\s*1|drop\s+table)", False),
    "has_path_traversal": (r"(?:\.\./|/etc/passwd|%2e%2e)", False),
    "has_cmd_injection": (r"(?:;\s*\w|`[^`]+`|\$\(|&&\s*\w)", True),
    "has_internal_ip_scan": (r"(?:10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+)", True),
    "has_port_forwarding": (r"ssh\s+.*-[LRD]\s|socat\b|proxychains\b", False),
}
HEX = "(?:[0-9a-fA-F]{2}){10,}"
TLS = "(?:ClientHello|TLS|SSL)"
LEAKS = (
    r"I (cannot|can't|am unable|will not|won't)|As an (AI|language model|assistant)|I don'?t have (access|the ability)|I'?m sorry|\bNote:\b|\bPlease note\b"
    r"|I am designed to|my (training|knowledge cutoff)|I should (mention|clarify|point out)"
)
SUSPECTS = "curl|wget|chmod|bash|python|nc |ncat|xmrig|miner|botnet|dropper|backdoor"
CREDENTIALS = "'root:root', 'admin:admin', 'root:123456', 'admin:password', 'test:test', 'root:toor', 'admin:1234', 'root:admin', 'user:user'"
PORTS = "21, 22, 23, 80, 443, 3389"
#: The SSH sensor's event ids with the types they stand for.
SSH_IDS = [
    ("cowrie.login.failed", "ssh_login_failed"), ("cowrie.login.success", "ssh_login_success"), ("cowrie.client.fingerprint", "ssh_publickey_attempt"), ("cowrie.session.connect", "ssh_connect"),
    ("cowrie.session.closed", "ssh_disconnect"), ("cowrie.session.params", "ssh_session_parameters"), ("cowrie.command.input", "ssh_command"), ("cowrie.command.failed", "ssh_command_failed"),
    ("cowrie.session.file_upload", "ssh_file_uploaded"), ("cowrie.session.file_download", "ssh_file_downloaded"), ("cowrie.virustotal.scanfile", "malware_virustotal_scan"),
    ("cowrie.client.version", "ssh_client_version"), ("cowrie.client.kex", "ssh_key_exchange"), ("cowrie.client.size", "ssh_terminal_resize"), ("cowrie.direct-tcpip.request", "ssh_port_forward_request"),
    ("cowrie.direct-tcpip.data", "ssh_port_forward_data"), ("cowrie.log.closed", "ssh_tty_log_closed"), ("cowrie.client.var", "ssh_env_variable"),
    ("cowrie.direct-tcpip.ja4", "ssh_direct_tcpip_ja4_fingerprint"), ("cowrie.direct-tcpip.ja4h", "ssh_direct_tcpip_ja4_fingerprint_hashed"), ("cowrie.none.such", "unknown"),
]
