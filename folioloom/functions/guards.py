"""Checks on names, keys, paths and addresses, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that outside names may have.
COLLECTION_NAME = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
UNSAFE = r"[^A-Za-z0-9._-]"
STORE_OPTIONS = ("api_key", "host", "password", "port", "timeout", "url", "user")

#: Networks that no request may reach, as (first, last) 32-bit numbers: special-purpose blocks of the IPv4 registry.
_BLOCKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")


def safe_name(c: Column, fallback: str = "file") -> Column:
    """Other characters than letters, digits, dot, dash and underscore become underscores; dots and underscores at the ends go."""
    clean = F.regexp_replace(F.regexp_replace(c, UNSAFE, "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def is_collection_name(c: Column) -> Column:
    return F.coalesce(c.rlike(COLLECTION_NAME) & ~c.endswith("\n"), F.lit(False))


def is_http(url: Column) -> Column:
    """An http or https address with a host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce(scheme.isin("http", "https") & (host(url) != ""), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def is_private_address(address: Column) -> Column:
    """Whether an address lies in a network that is not public, or is written so that only a resolver could tell."""
    parts = F.split(address, r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))
    inside = F.lit(False)
    for block in _BLOCKS:
        base, bits = block.split("/")
        first = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        inside |= number.between(first, first + (1 << (32 - int(bits))) - 1)
    four = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    # Other ways to write an IPv4 address, as one number, with fewer parts, in hexadecimal or within an IPv6 one, are refused whatever they say.
    other = address.rlike(r"(?i)^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*\.?$") & ~(four & ~address.rlike(r"(^|\.)0\d"))
    other |= address.rlike(r"(?i)^\[?[0-9a-f:]*:(ffff:)?(\d+\.){3}\d+\]?$") | address.rlike(r"(?i)^\[?(::|(0+:)+:?)ffff:[0-9a-f:]+\]?$") | address.rlike(r"(?i)^\[?(64:ff9b|2002):")
    six = address.rlike(r"(?i)^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)\]?$")
    return F.coalesce((four & inside) | six | other, F.lit(False))


def is_public_url(url: Column) -> Column:
    """http or https, and no literal address of a network that is not public; names are not resolved here."""
    return is_http(url) & ~is_private_address(host(url)) & ~host(url).isin("localhost")


def safe_key(c: Column) -> Column:
    """An object key with unsafe characters replaced; null for an absolute path or one that climbs."""
    clean = F.regexp_replace(c, r"[^A-Za-z0-9._/-]", "_")
    bad = (F.length(c) == 0) | c.startswith("/") | c.startswith("\\") | clean.contains("..")
    return F.when(~bad, clean)


def safe_options(c: Column) -> Column:
    """Of a map of store options those that callers may set."""
    return F.map_filter(c, lambda k, _: k.isin(*STORE_OPTIONS))
