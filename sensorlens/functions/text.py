"""Expressions over text and lists of text: pattern flags, entropies, lengths, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .walks import backspaced

#: Flag -> (pattern, whether case counts). They run on the commands of a session, joined by '|'.
COMMAND_FLAGS = {
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
#: Runs of hexadecimal digits, and words of encrypted connections.
HEX_RUN = r"(?:[0-9a-fA-F]{2}){10,}"
TLS_HINT = r"(?:ClientHello|TLS|SSL)"
#: Phrases that give a language model away.
LEAKAGE = [
    r"I (cannot|can't|am unable|will not|won't)",
    r"As an (AI|language model|assistant)",
    r"I don'?t have (access|the ability)",
    r"I'?m sorry",
    r"\bNote:\b",
    r"\bPlease note\b",
    r"I am designed to",
    r"my (training|knowledge cutoff)",
    r"I should (mention|clarify|point out)",
]
#: Control sequences of terminals, and control characters other than those of lines, tabs and backspaces.
ANSI = r"(?s)(\x1b(\[[0-?]*[ -/]*[@-~]|\].*?(?:\x07|\x1b\\)|[()][AB012]|[ -/]*[0-~])|[\x00-\x06\x0e-\x1a\x1c-\x1f]|\x7f|\x9b[0-?]*[ -/]*[@-~])"
#: What dashboards mark as suspicious.
SUSPICIOUS = [r"curl|wget|chmod|bash|python|nc |ncat", r"xmrig|miner|botnet|dropper|backdoor"]


def flag(text: Column, pattern: str, case: bool = False) -> Column:
    """1 if ``pattern`` is found, else 0; a dot stops at line feeds only."""
    return F.coalesce(text.rlike(("(?Ud)" if case else "(?iUd)") + pattern), F.lit(False)).cast("int")


def leaks(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iUd)" + "|".join(LEAKAGE)), F.lit(False))


def suspicious(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iUd)" + "|".join(SUSPICIOUS)), F.lit(False))


def contains(text: Column, part: str) -> Column:
    """Whether ``part`` is found, in any case; false for null."""
    return F.coalesce(F.lower(text).contains(part.lower()), F.lit(False))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def list_entropy(items: Column) -> Column:
    """Bits of the multiset ``items``; 0 for none. Equal items are neighbours once sorted, so runs tell their numbers."""

    def bits(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda at: F.transform(at, lambda x, k: (F.coalesce(F.get(at, k + 1), n) - x) / n)
        return bound(starts, lambda at: F.aggregate(run(at), F.lit(0.0), lambda a, p: a - p * F.log2(p)))

    return F.when(F.size(items) > 0, bound(F.array_sort(items), bits) + 0.0).otherwise(0.0)


def char_entropy(text: Column) -> Column:
    """Bits of the characters of ``text``; 0 for an empty or null one."""
    return list_entropy(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), F.lit(0)))


def mean_of(values: Column) -> Column:
    """Mean of a list of numbers; 0 for none."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def max_of(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def clean_input(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(backspaced(strip_control(text)), r"^[\r\n]+|[\r\n]+$", ""), r"(?U)^\s+|\s+$", "")


def clean_output(text: Column) -> Column:
    lines = F.regexp_replace(strip_control(text), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?Um)[^\S\n]+$", ""), r"(?U)^\s+|\s+$", "")


def template(system: Column, instruction: Column, output: Column | None = None) -> Column:
    """A chat prompt; with ``output``, a training example."""
    parts = [F.lit("<|system|>\n"), system, F.lit("<|end|>\n<|user|>\n"), instruction, F.lit("<|end|>\n<|assistant|>\n")]
    return F.concat(*parts) if output is None else F.concat(*parts, output, F.lit("<|end|>"))


def without_prompt(raw: Column, prompt: Column) -> Column:
    """Generated text without the prompt it may begin with and without chat tokens."""
    rest = F.when(F.startswith(raw, prompt), F.substr(raw, F.length(prompt) + 1)).otherwise(raw)
    return F.trim(F.regexp_replace(rest, r"<\|(?:system|user|assistant|end|endoftext)\|>|</s>", ""))
