"""Addresses on the web as a source: fetched in rounds of redirects, every hop checked.

The addresses to fetch are a table, the frontier.  A round deals it out by host and
fetches each distinct address once; what redirects makes the next frontier, less
what has been fetched before.  Before a request, and again for every hop, the host
is resolved and all its addresses are checked: one that isn't public refuses the
request.  The request goes to an address that was checked, so a name can't mean
another one meanwhile.

How names are resolved and bytes are fetched is given: ``resolve(host)`` lists
addresses, ``fetch(url, address)`` gives a ``Response``.  Both are made once for
each task by ``make``.

A host is fetched by at most ``lanes`` tasks at a time, one request after another,
and ``pause`` seconds lie between requests of a task.

Defined cases: a null address, another scheme than http and https, a name that
can't be resolved, a refused address, more than ``hops`` redirects or a circle of
them, a status other than success, and more than ``MOST`` bytes are rows with
``error``; repeated addresses are fetched once and each get their row.
"""

from __future__ import annotations

import ipaddress
import posixpath
import socket
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import routing

#: Redirects of one address, tasks for one host, and bytes of one answer.
HOPS, LANES, MOST = 5, 4, 256 << 20

# Statuses that say where to look instead, and what a name without an ending counts as.
REDIRECTS = (301, 302, 303, 307, 308)
DEFAULT_ENDING = ".jpg"

FETCHED = "at string, target string, content binary, error string"


@dataclass(frozen=True)
class Response:
    status: int
    content: bytes = b""
    location: str | None = None


Resolve = Callable[[str], Sequence[str]]
Fetch = Callable[[str, str], Response]


def is_public(address: str) -> bool:
    """Whether an IP address is one that anyone may reach; what holds an IPv4 address within counts as that."""
    ip = ipaddress.ip_address(address.split("%")[0])
    if isinstance(ip, ipaddress.IPv6Address):
        within = ip.ipv4_mapped or ip.sixtofour or (ip.teredo and ip.teredo[1])
        if within is None and ip in ipaddress.ip_network("64:ff9b::/96"):
            within = ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)
        if within is not None:
            return is_public(str(within))
    return ip.is_global and not (ip.is_multicast or ip.is_reserved or ip.is_unspecified or ip.is_loopback or ip.is_link_local)


def literal(host: str) -> str | None:
    """The IP address that a host spells out, in any of the ways that resolvers take: dotted, one number, hexadecimal, octal, fewer parts."""
    try:
        return str(ipaddress.ip_address(host))
    except ValueError:
        pass
    try:
        return socket.inet_ntoa(socket.inet_aton(host)) if host[:1].isdigit() else None
    except OSError:
        return None


def checked(url: str, resolve: Resolve, allow_private: bool = False) -> str:
    """The address to send a request to; a ValueError says why not."""
    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        raise ValueError("only http and https are fetched")
    spelt = literal(parts.hostname)
    found = [spelt] if spelt else list(resolve(parts.hostname))
    if not found:
        raise ValueError(f"no address for {parts.hostname}")
    for address in found:
        if not allow_private and not is_public(address):
            raise ValueError(f"refused: {address} is not public")
    return found[0]


def resolve_by_system(host: str) -> list[str]:
    """The system's resolver."""
    return [x[4][0] for x in socket.getaddrinfo(host, None, proto=socket.IPPROTO_TCP)]


def _fetched(make: Callable[[], tuple[Resolve, Fetch]], pause: float, allow_private: bool) -> Callable:
    def one(at: str, resolve: Resolve, fetch: Fetch) -> tuple:
        try:
            got = fetch(at, checked(at, resolve, allow_private))
            if got.status in REDIRECTS:
                return (at, None, None, f"ValueError: status {got.status} without a place") if not got.location else (at, urljoin(at, got.location), None, None)
            if not 200 <= got.status < 300:
                raise ValueError(f"status {got.status}")
            if len(got.content) > MOST:
                raise ValueError(f"more than {MOST} bytes")
            return at, None, got.content, None
        except Exception as e:  # one bad address never fails the others
            return at, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, first = None, True
        for batch in batches:
            for at in batch.column(0).to_pylist():
                tools = tools or make()
                if pause and not first:
                    time.sleep(pause)
                first = False
                row = one(at, *tools)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["at", "target", "content", "error"])

    return run


def fetch(urls: DataFrame, make: Callable[[], tuple[Resolve, Fetch]], hops: int = HOPS, lanes: int = LANES, pause: float = 0.0, allow_private: bool = False) -> DataFrame:
    """(url, final, content, error) of every row of the one column of addresses."""
    spark, column = urls.sparkSession, urls.columns[0]
    rows = urls.select(F.col(column).cast("string").alias("url"))
    way = scratch.keep(rows.where("url is not null").distinct().select("url", F.col("url").alias("at")))  # where each address has led so far
    frontier, fetched, done = way.select("at"), None, None
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for hop in range(hops + 1):
        host = F.regexp_extract(F.lower("at"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
        dealt = frontier.distinct().select("at", host.alias("host"), F.pmod(F.xxhash64("at"), F.lit(lanes)).alias("lane")).repartition(tasks, "host", "lane")
        new = scratch.keep(dealt.select("at").mapInArrow(_fetched(make, pause, allow_private), FETCHED))
        fetched = new if fetched is None else fetched.unionByName(new)
        # The answer to where each address stands, which another may have asked for in an earlier round.
        stands = way.join(fetched.select("at", "target", "error"), "at")
        ended = stands.where("target is null").select("url", "at", F.lit(None).cast("string").alias("late"))
        moved = stands.where("target is not null")
        if hop == hops:
            ended = ended.unionByName(moved.select("url", "at", F.lit(f"ValueError: more than {hops} redirects").alias("late")))
        ended = scratch.keep(ended)
        done = ended if done is None else done.unionByName(ended)
        way = scratch.keep(moved.select("url", F.col("target").alias("at")))
        if hop == hops or way.isEmpty():
            break
        frontier = way.select("at").join(fetched.select("at"), "at", "left_anti")
    got = done.join(fetched.select("at", "content", "error"), "at").select("url", F.col("at").alias("final"), "content", F.coalesce("late", "error").alias("error"))
    out = rows.where("url is not null").join(got, "url")
    none = rows.where("url is null").select("url", F.lit(None).cast("string").alias("final"), F.lit(None).cast("binary").alias("content"), F.lit("ValueError: no address").alias("error"))
    return out.unionByName(none)


def files(fetched: DataFrame) -> DataFrame:
    """(path, name, kind, content, error) for ``readers.parse_files``: the path is the address asked for, and a name without an ending counts as a picture."""

    @F.pandas_udf("string")
    def name(urls):
        return urls.map(lambda u: posixpath.basename(unquote(urlsplit(u).path)) or "downloaded_file" if u is not None else None)

    named = fetched.select(F.col("url").alias("path"), name("url").alias("name"), "content", "error")
    kind = routing.file_format(F.when(F.col("name").rlike(r".\.[^.]+$"), F.col("name")).otherwise(F.concat("name", F.lit(DEFAULT_ENDING))))
    return named.select("path", "name", kind.alias("kind"), "content", "error")
