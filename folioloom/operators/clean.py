"""Row-wise cleaning of elements; every step keeps the columns of its input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text

Step = Callable[[DataFrame], DataFrame]

# Element types that a rule passes by.
UNSPACED = ("code", "table")
UNMEASURED = ("image", "table", "code", "hr")


def drop_control(df: DataFrame) -> DataFrame:
    """Removes control characters, except tab and line ends, from content and raw content."""
    return df.withColumns({c: text.drop_control(F.col(c)) for c in ("content", "raw_content") if c in df.columns})


def tidy_space(df: DataFrame, compose: bool = True) -> DataFrame:
    """Composes and tidies white space in content, but for code and tables.

    ``compose=False`` leaves out the compatibility composition, the one part that needs Python.
    """
    keep = F.col("type").isin(*UNSPACED)
    return df.withColumn("content", F.when(keep, F.col("content")).otherwise(text.tidy_space(F.col("content"), compose)))


def mask_personal(df: DataFrame) -> DataFrame:
    """Masks phones, national ids and e-mail addresses in content, of every type; raw content stays."""
    return df.withColumn("content", text.mask_personal(F.col("content")))


def long_enough(least: int = 3) -> Column:
    """Whether content is long enough and has a word character; some types always are."""
    bare = text.strip(F.coalesce("content", F.lit("")))
    return F.col("type").isin(*UNMEASURED) | ((F.length(bare) >= least) & text.has_word(bare))


def drop_short(df: DataFrame, least: int = 3) -> DataFrame:
    return df.where(long_enough(least))


def default_steps(deduplicate: bool = True) -> list[Step]:
    """Control characters, space, personal data, length of 2, and unless switched off margins and near duplicates.

    Length, margins and near duplicates read their rows more than once, so what the
    steps before them give is written.
    """
    from . import dedup

    steps: list[Step] = [drop_control, tidy_space, mask_personal]
    length: Step = lambda df: drop_short(df, 2)
    return steps + ([scratch.keep, length, dedup.drop_margins, dedup.drop_near_duplicates] if deduplicate else [length])


def clean(df: DataFrame, steps: Sequence[Step] | None = None, deduplicate: bool = True) -> DataFrame:
    """Applies the steps in order; row-wise ones are lazy, so they end up in one scan."""
    for step in default_steps(deduplicate) if steps is None else steps:
        df = df.transform(step)
    return df
