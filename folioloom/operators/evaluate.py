"""Scoring retrieval against labelled line spans.

``retrievals``: strategy, qid, rank, start_line, end_line.  ``spans``: qid,
span_idx, start_line, end_line.  ``queries``: qid, type, expected_advantage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket in which chunks and spans meet.
LINES = 128
HIT_HIGH, NOISE_HIGH, SATURATED, SKEWED = 0.6, 0.5, 0.95, 2


def overlaps(start: Column, end: Column, gold_start: Column, gold_end: Column) -> Column:
    """Closed intervals meet; an open end is the start, a missing start meets nothing."""
    return F.coalesce((start <= gold_end) & (gold_start <= F.coalesce(end, start)), F.lit(False))


def score(retrievals: DataFrame, spans: DataFrame) -> DataFrame:
    """Per strategy and query: hit, first hit, reciprocal rank, noise, spans covered."""
    gold = spans.select(F.col("qid").alias("_q"), "span_idx", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), *([F.col("doc_id").alias("_d")] if "doc_id" in spans.columns else []))
    same = F.col("doc_id") == F.col("_d") if "doc_id" in spans.columns and "doc_id" in retrievals.columns else F.lit(True)
    met = (F.col("qid") == F.col("_q")) & same & overlaps(F.col("start_line"), F.col("end_line"), F.col("_s"), F.col("_e"))
    joined = retrievals.join(gold, met, "left")
    each = joined.groupBy("strategy", "qid").agg(
        F.min(F.when(F.col("_q").isNotNull(), F.col("rank"))).alias("first_hit_rank"),
        F.countDistinct(F.when(F.col("_q").isNotNull(), F.col("rank"))).alias("_hits"),
        F.countDistinct("rank").alias("returned"),
        F.countDistinct("span_idx").alias("spans_covered"),
    )
    totals = spans.groupBy("qid").agg(F.count("*").alias("spans_total"))
    out = each.join(totals, "qid", "left")
    return out.select(
        "strategy",
        "qid",
        F.col("first_hit_rank").isNotNull().alias("hit"),
        "first_hit_rank",
        F.coalesce(F.lit(1.0) / F.col("first_hit_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        ((F.col("returned") - F.col("_hits")) / F.col("returned")).alias("noise"),
        "returned",
        F.coalesce("spans_total", F.lit(0)).alias("spans_total"),
        "spans_covered",
    )


def metrics(scores: DataFrame, *keys: str) -> DataFrame:
    """Hit rate, micro recall, mean reciprocal rank and mean noise, by these keys."""
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n_queries"),
        F.avg(F.col("hit").cast("double")).alias("hit_at_k"),
        F.coalesce(F.try_divide(F.sum("spans_covered"), F.sum("spans_total")), F.lit(0.0)).alias("recall"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("noise").alias("noise_at_k"),
    )


def report(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """Metrics by strategy, and by strategy and type, in one pass; ``type`` is null in the totals."""
    typed = scores.join(queries.select("qid", "type"), "qid")
    sets = typed.groupingSets([["strategy"], ["strategy", "type"]], "strategy", "type")
    return sets.agg(F.count("*").alias("n_queries"), F.avg(F.col("hit").cast("double")).alias("hit_at_k"), F.avg("reciprocal_rank").alias("mrr"), F.avg("noise").alias("noise_at_k"))


def agreement(scores: DataFrame, queries: DataFrame, strategies: list[str]) -> DataFrame:
    """Per query with an expectation: the best strategy by first hit, ties in the order given, and whether it was expected."""
    place = F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy"))
    best = scores.where("hit").groupBy("qid").agg(F.min_by("strategy", F.struct("first_hit_rank", place)).alias("best"))
    wanted = queries.where(F.coalesce("expected_advantage", F.lit("")) != "")
    joined = wanted.join(best, "qid", "left")
    return joined.select("qid", "type", "expected_advantage", "best", F.coalesce(F.col("best") == F.col("expected_advantage"), F.lit(False)).alias("agrees"))


def counts_at(intervals: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, started, ended): how many closed intervals (keys, start, end) begin at or before each position, and how many end before it.

    A sweep over starts, ends and positions in one order.  Each of them is one row
    for all that fall on it, running counts go within buckets of ``LINES``, and
    what lies before a bucket is added from sums by bucket: nothing is spread over
    the buckets it covers, and intervals and positions never meet in pairs.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    row = lambda df, at, *what: df.select(*keys, F.col(at).alias("position"), *(w.alias(n) for w, n in zip(what, ("s", "e", "w"), strict=True)))
    events = row(intervals, "start", one, zero, zero).unionByName(row(intervals, "end", zero, one, zero)).unionByName(row(positions, "position", zero, zero, one))
    events = events.groupBy(*keys, "position").agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("w").alias("w")).withColumn("b", F.floor(F.col("position") / LINES))
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy(*keys, "b").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("b").alias("_b"), F.coalesce(F.sum("s").over(before), zero).alias("_s"), F.coalesce(F.sum("e").over(before), zero).alias("_e"))
    within = Window.partitionBy(*keys, "b").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("b") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    ran = events.select(*keys, "position", "b", "w", F.sum("s").over(within).alias("s"), (F.sum("e").over(within) - F.col("e")).alias("e")).where("w = 1")
    return ran.join(sums, same).select(*keys, "position", (F.col("s") + F.col("_s")).alias("started"), (F.col("e") + F.col("_e")).alias("ended"))


def coverage(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Per query and strategy: how many of its spans some chunk of that strategy overlaps.

    A chunk overlaps a span unless it ends before the span's start or begins after
    its end, so some chunk does if more have begun by the end than had ended
    before the start; ``counts_at`` gives both.  Documents are kept apart where
    both sides have ``doc_id``.
    """
    by = ["doc_id"] if "doc_id" in chunks.columns and "doc_id" in spans.columns else []
    keys = [*by, "strategy"]
    placed = chunks.where("start_line is not null and start_line <= coalesce(end_line, start_line)").select(*keys, F.col("start_line").cast("long").alias("start"), F.coalesce("end_line", "start_line").cast("long").alias("end"))
    strategies = chunks.select("strategy").distinct().agg(F.collect_set("strategy").alias("_all"))  # one row, of as many items as there are strategies
    wanted = spans.select(*by, "qid", "span_idx", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("z"))
    sound = wanted.where("a <= z").crossJoin(strategies).withColumn("strategy", F.explode("_all")).drop("_all")
    at = counts_at(placed, sound.select(*keys, F.explode(F.array("a", "z")).alias("position")).distinct(), keys)
    same = lambda df, place: [F.col(place) == df["_p"], *(F.col(k).eqNullSafe(df[f"_{k}"]) for k in keys)]
    of = lambda name, what: at.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("position").alias("_p"), F.col(what).alias(name))
    begun, over = of("begun", "started"), of("over", "ended")
    met = sound.join(begun, same(begun, "z")).drop(*(f"_{k}" for k in keys), "_p").join(over, same(over, "a")).where("begun > over")
    covered = met.groupBy("qid", "strategy").agg(F.countDistinct("span_idx").alias("covered"))
    totals = wanted.groupBy("qid").agg(F.countDistinct("span_idx").alias("total"))
    every = totals.crossJoin(strategies).select("qid", "total", F.explode("_all").alias("strategy"))
    return every.join(covered, ["qid", "strategy"], "left").select("qid", "strategy", "total", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def reading(hit: Column, noise: Column) -> Column:
    """What a pair of hit rate and noise says about chunk size."""
    good, loud = hit >= HIT_HIGH, noise >= NOISE_HIGH
    return F.when(good & ~loud, "ideal").when(good, "chunks too small").when(~loud, "chunks too large").otherwise("change strategy")


def normalised_k(n_chunks: Column, ratio: float, least: int) -> Column:
    """A k in proportion to the number of chunks, halves to even."""
    return F.greatest(F.lit(least), F.bround(n_chunks * ratio).cast("int"))


def invalid_golden(queries: DataFrame, spans: DataFrame, n_lines: int | None = None) -> DataFrame:
    """(qid, problem) of every flaw of a labelled set."""
    problem = lambda df, words: df.select("qid", F.lit(words).alias("problem"))
    repeated = queries.groupBy("qid").count().where("count > 1")
    bare = queries.join(spans.select("qid").distinct(), "qid", "left_anti")
    out = problem(queries.where("qid IS NULL OR qid = ''"), "no id").union(problem(repeated, "repeated id")).union(problem(bare, "no spans"))
    out = out.union(problem(spans.where("start_line IS NULL OR end_line IS NULL"), "span without lines"))
    out = out.union(problem(spans.where("start_line > end_line"), "span runs backwards"))
    return out.union(problem(spans.where(F.col("end_line") > n_lines), "span beyond the document")) if n_lines is not None else out


def warnings(scores: DataFrame, n_chunks: DataFrame, fixed_k: bool = True) -> DataFrame:
    """(strategy, warning) for results that don't tell the strategies apart; strategy is null where all are meant.

    ``n_chunks``: strategy, n_chunks.
    """
    sizes = n_chunks.agg(F.count("*").alias("n"), F.countDistinct("n_chunks").alias("d"), F.min("n_chunks").alias("lo"), F.max("n_chunks").alias("hi"))
    hits = scores.groupBy("strategy").agg(F.avg(F.col("hit").cast("double")).alias("hit"), F.count("*").alias("n"), F.countDistinct(F.round("noise", 6)).alias("d"))
    full = hits.agg(F.count("*").alias("n"), F.count_if(F.col("hit") >= SATURATED).alias("s"))
    nobody = F.lit(None).cast("string").alias("strategy")
    say = lambda df, words, who=nobody: df.select(who, F.lit(words).alias("warning"))
    out = say(sizes.where("n > 1 and d = 1"), "all strategies made equally many chunks")
    out = out.union(say(scores.where("returned = 0"), "a search returned nothing", F.col("strategy")).distinct())
    out = out.union(say(hits.where("n > 3 and d = 1"), "noise is the same for every query", F.col("strategy")))
    out = out.union(say(full.where("n > 1 and s = n"), "hit rates of all strategies are saturated"))
    part = hits.crossJoin(full.select(F.col("n").alias("_n"), F.col("s").alias("_s"))).where("not (_n > 1 and _s = _n)")  # one row
    out = out.union(say(part.where(F.col("hit") >= SATURATED), "hit rate is saturated", F.col("strategy")))
    return out.union(say(sizes.where(f"d > 1 and hi >= {SKEWED} * lo"), "chunk counts differ widely under a fixed k")) if fixed_k else out


def vector_gate(probe: DataFrame, least: float = 0.05) -> DataFrame:
    """One row: whether both embedding paths tell like from unlike and agree in length.

    ``probe``: path, dimension, separation.
    """
    return probe.agg(F.min("separation").alias("least_separation"), (F.countDistinct("dimension") == 1).alias("same_dimension"), ((F.min("separation") > least) & (F.countDistinct("dimension") == 1)).alias("passes"))
