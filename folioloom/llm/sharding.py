"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id, place in the table).  For each boundary between shards,
candidate keys are probed: exact bytes below every probe are summed across all
partitions in one aggregation, the cell that holds the boundary's target becomes
the next interval, and so on until each boundary is within tolerance of its
target or stands between two neighbouring rows.  Equal texts share the first
part of the key; where one group of them spans a boundary, probing goes on over
the ids within the group, and over the places of rows that repeat an id, so a
group of any size is split exactly.  The rows are exchanged once, by shard and
cell, where they get their slots; a cell is a range of hashes, and only cells of
too many rows, which a group of equal texts makes, are cut further.

The driver sees at most ``PROBES`` sums per boundary and round.

Laws: ``bytes`` makes the shards' bytes near equal; ``rows`` makes their row
counts at most one apart, at every size; ``key`` puts a row where its id and the number of shards say (the shard with the
highest hash), so that one more shard takes rows only into itself.

Defined cases: a null text counts as 0 bytes plus ``ROW_BYTES``; null ids come
first; rows that repeat an id and a text are rows of their own; an empty table
has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 40
ROW_BYTES = 16
PROBES = 256
#: Largest distance of a boundary from its target, as a share of a shard.
TOLERANCE = 5e-4
#: Rows that get their slots in one task, about.
SLOT_ROWS = 500_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


#: The key's parts: hash of the text, id, place in the table.
KEY = ("_u", "_d", "_r")


def _below(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted bounds are at or below the row's key: a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        u, d, r = (F.lit(x) for x in bounds[middle])
        inner = (F.col("_d") > d) | ((F.col("_d") == d) & (F.col("_r") >= r))
        at_or_above = (F.col("_u") > u) | ((F.col("_u") == u) & inner)
        return F.when(at_or_above, tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds))


def _cells(spans: list[tuple], probes: int) -> Column:
    """struct(span, cell) of a row: the span it lies in, if any, and where in it."""
    cases = None
    for k, (fixed, lo, hi) in enumerate(spans):
        part, step = KEY[len(fixed)], max(1, -(-(hi - lo) // probes))
        here = F.expr(" and ".join([*(f"{c} = '{x}'" for c, x in zip(KEY, fixed, strict=False)), f"{part} >= '{lo}'", f"{part} <= '{hi - 1}'"]))
        if hi - lo < 1 << 63 and lo >= 0:
            cell = F.expr(f"({part} - {lo}L) div {step}L")
        else:  # ids can lie further apart than a long holds
            cell = F.expr(f"cast((cast({part} as decimal(20,0)) - cast('{lo}' as decimal(20,0))) div cast('{step}' as decimal(20,0)) as bigint)")
        value = F.struct(F.lit(k).alias("span"), cell.alias("cell"))
        cases = F.when(here, value) if cases is None else cases.when(here, value)
    return cases


def boundaries(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """shards - 1 keys; ``keyed`` has the key's parts (_u and _r are not negative) and _w, the weight that is to be equal.

    With a tolerance of 0 and weights of 1 the parts' sizes are at most one apart.
    """
    total = keyed.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first().w
    slack = tolerance * total / shards
    # A search: the parts of the key that are settled, [lo, hi) of the next part, and the weight below lo.
    open_: dict[int, tuple[tuple, int, int, int]] = {j: ((), 0, 1 << 63, 0) for j in range(1, shards)}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        spans = sorted({x[:3] for x in open_.values()}, key=lambda x: (len(x[0]), x[0], x[1]))
        probes = PROBES if len(spans) > 1 else 16 * PROBES
        sums = keyed.select(_cells(spans, probes).alias("c"), *KEY, "_w").where("c is not null")
        ends = [f(c).alias(f"{n}{c}") for c in KEY for f, n in ((F.min, "min"), (F.max, "max"))]
        cells: dict[int, list] = {}
        for r in sums.groupBy("c.span", "c.cell").agg(F.sum("_w").alias("w"), *ends).collect():
            cells.setdefault(r.span, []).append(r)
        for j, (fixed, lo, hi, below) in list(open_.items()):
            target = j * total // shards
            least = (_LEAST,) * (len(KEY) - len(fixed) - 1)
            for r in sorted(cells.get(spans.index((fixed, lo, hi)), []), key=lambda r: r.cell):
                if below + r.w >= target:
                    break
                below += r.w
            else:
                done[j] = (*fixed, hi, *least)  # nothing is left above: no row there
                del open_[j]
                continue
            low, high = ([r[f"{n}{c}"] for c in KEY] for n in ("min", "max"))
            k = len(fixed)
            start, after = (*fixed, low[k], *least), (*fixed, high[k] + 1, *least)
            if target - below <= slack:
                done[j] = start
            elif below + r.w - target <= slack:
                done[j] = after
            elif low[k] < high[k]:
                open_[j] = (fixed, low[k], high[k] + 1, below)
                continue
            elif k + 1 < len(KEY) and low[k + 1 :] != high[k + 1 :]:
                open_[j] = ((*fixed, low[k]), low[k + 1], high[k + 1] + 1, below)
                continue
            else:  # one row
                done[j] = start if target - below <= below + r.w - target else after
            del open_[j]
    return [min(done[j], (_MOST, _MOST, _MOST)) for j in sorted(done)]


def _by_key(shards: int) -> Column:
    """The shard with the highest hash of the id and the shard's number."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.col("doc_id"), s).alias("h"), s.alias("s")))
    return F.array_max(scored)["s"].cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", tolerance: float = TOLERANCE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"no such law: {law}")
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("_u"),
        F.monotonically_increasing_id().alias("_r"),
    ).withColumn("_d", F.coalesce("doc_id", F.lit(_LEAST)))
    kept = scratch.keep(thin)
    if law == "key":
        placed = kept.withColumns({"shard": _by_key(shards), "grown_shard": _by_key(shards + 1)})
    else:
        keyed = kept.select(*KEY, (F.col("size") if law == "bytes" else F.lit(1).cast("long")).alias("_w"))
        bounds = boundaries(keyed, shards, tolerance if law == "bytes" else 0)
        placed = kept.withColumns({"shard": _below(bounds).cast("int"), "grown_shard": F.lit(None).cast("int")})
    return _numbered(placed, kept.count()).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def _numbered(placed: DataFrame, rows: int, per_cell: int = 0) -> DataFrame:
    """The rows with their slots: numbers from 0 in each shard, given in cells of about SLOT_ROWS rows."""
    per_cell = per_cell or SLOT_ROWS
    deep = max(1, rows // per_cell)
    placed = placed.withColumn("cell", F.expr(f"_u div {min(_MOST, -(-(1 << 63) // deep))}L"))
    # Cells of too many rows, at most rows / (2 * SLOT_ROWS) of them, are cut by the rows' own hash.
    large = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).where(f"n > {2 * per_cell}")
    placed = placed.join(F.broadcast(large), ["shard", "cell"], "left")
    placed = placed.withColumn("cut", F.coalesce(F.pmod(F.xxhash64("_d", "_r"), F.ceil(F.col("n") / per_cell)), F.lit(0))).drop("n")
    counts = placed.groupBy("shard", "cell", "cut").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "cell", "cut", "sum(n) over (partition by shard order by cell, cut) - n as below")
    numbered = placed.join(before, ["shard", "cell", "cut"])
    return numbered.withColumn("slot", F.expr("below + row_number() over (partition by shard, cell, cut order by _u, _d, _r) - 1"))
