"""Expressions over addresses, ports and organisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Fixed values.
SENSITIVE_PORTS = [21, 22, 23, 80, 443, 3389]
PORT_NAMES = {22: "SSH", 23: "Telnet", 21: "FTP", 80: "HTTP", 443: "HTTPS", 3389: "RDP", 3306: "MySQL", 5432: "Postgres"}
CLOUD_WORDS = ["cloud", "hosting", "digitalocean", "amazon", "azure", "google", "tencent", "alibaba", "vps", "ovh", "linode", "hetzner", "contabo"]
ISP_WORDS = ["telecom", "isp", "mobile", "communications", "broadband", "network"]
DEFAULT_CREDENTIALS = [
    ("root", "root"), ("admin", "admin"), ("root", "123456"), ("admin", "password"), ("test", "test"), ("root", "toor"), ("admin", "1234"), ("root", "admin"), ("user", "user"),
]
EVENT_CLASSES = ["login_success", "login_failed", "command", "download", "alert", "request"]


def is_public(ip: Column, strict: bool = False) -> Column:
    """Neither empty nor private. ``strict``: exactly the private ranges; else all of 172.10 to 172.39 counts as private."""
    private = [r"^192\.168\.", r"^10\.", r"^172\.(1[6-9]|2\d|3[01])\." if strict else r"^172\.[123].\."]
    return F.coalesce((ip != "") & (ip != "0.0.0.0") & ~reduce(lambda a, b: a | b, [ip.rlike(p) for p in private]), F.lit(False))


def port_name(port: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in PORT_NAMES.items() for x in kv))[port.cast("int")]


def organisation_class(org: Column) -> Column:
    low = F.lower(F.coalesce(org, F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(CLOUD_WORDS), "Hosting/Cloud").when(has(ISP_WORDS), "Residential/ISP").otherwise("Unknown/Other")


def event_class(event_type: Column) -> Column:
    """The first class whose name is in ``event_type``, else 'other'."""
    out = F.when(event_type.contains(EVENT_CLASSES[0]), EVENT_CLASSES[0])
    for name in EVENT_CLASSES[1:]:
        out = out.when(event_type.contains(name), name)
    return out.otherwise("other")


def default_credentials(users: Column, passwords: Column) -> Column:
    """1 if any user with any password is a known pair, in any case."""
    known = F.array(*(F.lit(f"{u}:{p}") for u, p in DEFAULT_CREDENTIALS))
    hit = F.exists(users, lambda u: F.exists(passwords, lambda p: F.array_contains(known, F.concat(F.lower(u), F.lit(":"), F.lower(p)))))
    return F.coalesce(hit, F.lit(False)).cast("int")
