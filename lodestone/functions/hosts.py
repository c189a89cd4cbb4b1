"""Hosts as browsers write them: internationalised names in ASCII, numbers as IPv4 addresses, IPv6 addresses compressed.

Plain ASCII names, nearly all, are told apart in the JVM and pass as they are; only the others go to Python, in Arrow
batches. ``ascii_url`` rewrites the host of an address and leaves the rest, so that url.parse() sees the browser's form;
an address whose host is none stays as it is. Names are mapped by lower case and NFKC, a
close subset of the standard's table. Null stays null.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that no host may hold, full stops of other scripts, and characters that a name loses.
FORBIDDEN = re.compile(r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]")
STOPS = re.compile("[。．｡]")
IGNORED = re.compile("[­͏᠋-᠍​⁠︀-️﻿]")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]*|[0-9]+")
_AUTHORITY = re.compile(r"(?s)\A(\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}(?:[^/\\?#]*@)?)(\[[^\]/\\?#]*\]|[^/\\?#:]*)(.*)\Z")


def ipv6(text: str) -> str | None:
    """The shortest form in brackets: the first of the longest runs of two or more zero pieces becomes two colons."""
    try:
        packed = ipaddress.IPv6Address(text).packed if "%" not in text else None
    except ValueError:
        return None
    if packed is None:
        return None
    pieces = [packed[i] << 8 | packed[i + 1] for i in range(0, 16, 2)]
    runs = [(i, next((j for j in range(i, 8) if pieces[j]), 8) - i) for i in range(8)]
    start, n = max(runs, key=lambda r: (r[1], -r[0]))
    shown = [f"{x:x}" for x in pieces]
    return f"[{':'.join(shown)}]" if n < 2 else f"[{':'.join(shown[:start])}::{':'.join(shown[start + n :])}]"


def _value(part: str) -> int | None:
    if not _NUMBER.fullmatch(part):
        return None
    if part[:2] in ("0x", "0X"):
        return int(part[2:] or "0", 16)
    if part[0] == "0" and len(part) > 1:
        return int(part, 8) if not re.search("[89]", part) else None
    return int(part)


def ipv4(parts: list[str]) -> str | None:
    """An address of up to four numbers, decimal, octal or hexadecimal; the last one fills the bytes that are left."""
    values = [_value(p) for p in parts]
    if len(parts) > 4 or None in values or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(parts)):
        return None
    total = values[-1] + sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1]))
    return ".".join(str(total >> 8 * (3 - i) & 255) for i in range(4))


def ascii_host(host: str) -> str | None:
    """A host as a browser writes it; None if it is none."""
    if host.startswith("["):
        return ipv6(host[1:-1]) if host.endswith("]") else None
    try:
        name = unquote_to_bytes(host).decode()
    except UnicodeDecodeError:
        return None
    name = unicodedata.normalize("NFKC", IGNORED.sub("", STOPS.sub(".", name)).lower()).lower()
    try:
        labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in STOPS.sub(".", name).split(".")]
    except UnicodeError:
        return None
    out = ".".join(labels)
    if not out or FORBIDDEN.search(out):
        return None
    tail = labels[:-1] if len(labels) > 1 and not labels[-1] else labels
    if tail[-1].isdigit() or _NUMBER.fullmatch(tail[-1]):
        return ipv4(tail)
    return out


def rewritten(address: str | None) -> str | None:
    """``address`` with its host in the browser's form, as it is if it has none."""
    m = _AUTHORITY.match(address or "")
    host = ascii_host(m[2]) if m else None
    return address if host is None else m[1] + host + m[3]


def ascii_url(raw: Column) -> Column:
    """``raw`` with the host in the browser's form."""

    @F.pandas_udf("string")
    def python(address: pd.Series) -> pd.Series:
        return address.map(rewritten, na_action="ignore")

    host = F.regexp_extract(raw, r"(?s)\A\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}(?:[^/\\?#]*@)?(\[[^/\\?#]*\]|[^/\\?#:]*)", 1)
    # the last label of a name starts with a letter, so no number looks plain
    plain = host.rlike(r"\A[a-z0-9_.~-]*\z") & host.rlike(r"(?:\A|\.)[a-wyz_][a-z0-9_-]*\.?\z") | (host == "")
    return F.coalesce(python(F.when(~plain, raw)), raw)
