"""Reproducible samples: a row's place in the draw is the md5 of seed and key.

The digest is uniform, so its first hex digits cut any stratum, however large, into equal
buckets.  Buckets beyond the sample are dropped before anything is sorted, and the rest is
ranked per bucket, so no stratum ends up in one task.  The input is read twice: store one
that is costly to compute.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.filters import exclude_bots
from emberline.session import store

HEX_DIGITS = 3


def draw(key: Column, seed: int | str) -> Column:
    """32 hex digits that order the rows of a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def uniform(key: Column, seed: int | str) -> Column:
    """Number in [0, 1) with 52 random bits."""
    return F.conv(F.substring(draw(key, seed), 1, 13), 16, 10).cast("double") / float(16**13)


def exact_sample_n(df: DataFrame, by: Sequence[str], n: int | Column | DataFrame, seed: int | str,
                   key: str) -> DataFrame:
    """``n`` rows per stratum without replacement (all rows of a smaller stratum).

    ``n`` is a number, a scalar subquery, or a frame with the strata columns and a column
    ``n``.
    """
    by = list(by)
    rows = df.withColumn("_draw", draw(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_draw", 1, HEX_DIGITS)
    )
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    # at most 16^3 rows per stratum
    order = Window.partitionBy(*by).orderBy("_bucket")
    sizes = sizes.withColumn("_upto", F.sum("_size").over(order))
    if isinstance(n, DataFrame):
        sizes = sizes.join(n.select(*by, F.col("n").alias("_want")), by)
    else:
        sizes = sizes.withColumn("_want", (n if isinstance(n, Column) else F.lit(n)).cast("long"))
    kept = sizes.filter(F.col("_upto") - F.col("_size") < F.col("_want")).select(
        *by, "_bucket", (F.col("_want") - F.col("_upto") + F.col("_size")).alias("_left")
    )
    place = Window.partitionBy(*by, "_bucket").orderBy("_draw", key)
    # a bucket wholly inside the sample has at least as many places left as rows
    drawn = rows.join(kept, [*by, "_bucket"]).withColumn("_place", F.row_number().over(place))
    return drawn.filter(F.col("_place") <= F.col("_left")).select(*df.columns)


def control_sample(posts: DataFrame, bots: DataFrame, wanted: DataFrame, seed: int | str,
                   by: Sequence[str] = ("month", "kind"), oversample: int = 3) -> DataFrame:
    """Control authors: draw three times as many posts as wanted authors, then thin the authors.

    Drawing posts makes busy authors likelier, as wished.  ``wanted`` holds strata and ``n``.
    """
    by = list(by)
    # each sample reads its rows twice: write them once, three columns of the pool and then authors
    pool = store(exclude_bots(posts, bots).select(*by, "author", "id"), "pool")
    wanted = store(wanted.select(*by, "n"), "wanted")
    more = wanted.withColumn("n", F.col("n") * oversample)
    drawn = exact_sample_n(pool, by, more, f"{seed}-posts", "id")
    authors = store(drawn.select(*by, "author").distinct(), "drawn")
    return exact_sample_n(authors, by, wanted, f"{seed}-authors", "author")


def case_control_sample(person_weeks: DataFrame, seed: int | str, ratio: int = 2) -> DataFrame:
    """All activation weeks and ``ratio`` times as many other weeks between weak and strong date.

    ``person_weeks`` has author, week_idx, sunday, date_weak, date_strong and activation.
    """
    cases = person_weeks.filter("activation")
    pool = person_weeks.filter(
        ~F.col("activation")
        & (F.col("date_weak") < F.col("sunday"))
        & (F.col("sunday") <= F.col("date_strong"))
    ).withColumn("_key", F.concat_ws("@", "author", F.col("week_idx").cast("string")))
    want = cases.agg(F.count("*") * ratio).scalar()
    drawn = exact_sample_n(pool, [], want, seed, "_key")
    return cases.unionByName(drawn.drop("_key"))


def pooled_negatives(tables: Sequence[DataFrame], label: str, date: str, since: Sequence) -> DataFrame:
    """Positives of the first table, and negatives of all tables dated ``since`` their class began.

    The tables are one per class with equal columns; ``since`` has a first date for each.
    """
    rows = tables[0].filter(F.col(label))
    for table, first in zip(tables, since):
        rows = rows.unionByName(table.filter(~F.col(label) & (F.col(date) >= F.lit(first).cast("date"))))
    return rows


def balance_classes(df: DataFrame, label: str, seed: int | str, key: str) -> DataFrame:
    """Every class cut to the size of the smallest."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    least = sizes.agg(F.min("size")).scalar()
    return exact_sample_n(df, [label], sizes.select(label, least.alias("n")), seed, key)


def train_test_split(df: DataFrame, key: str, seed: int | str, train: float = 0.75) -> DataFrame:
    """Adds ``is_train``, true for about ``train`` of the keys."""
    return df.withColumn("is_train", uniform(F.col(key), seed) < train)


# Fixed value: terms of the Poisson distribution kept; the rest has probability below 1e-13.
POISSON_TERMS = 16


def poisson_weight(u: Column, mean: float = 1.0) -> Column:
    """Poisson count (``mean`` at most 1) for a uniform number.

    Counts end at 15: a greater one has probability below 1e-13.
    """
    cdf, total = [], 0.0
    for k in range(POISSON_TERMS):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        cdf.append(total)
    steps = [F.when(u >= c, 1).otherwise(0) for c in cdf]
    return sum(steps[1:], steps[0]).cast("long")


def bootstrap_sample(df: DataFrame, replicates: int, seed: int | str, key: str) -> DataFrame:
    """Resampling weights: each row once per replicate in which it is drawn, with its weight.

    The count of a row in a resample of n out of n rows is close to Poisson(1); drawing it
    per row needs no global index and serves all replicates in one pass.
    """
    many = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    tag = F.concat_ws("|", F.col("replicate").cast("string"), F.col(key).cast("string"))
    drawn = many.withColumn("_u", uniform(tag, seed))
    return drawn.withColumn("weight", poisson_weight(F.col("_u"))).drop("_u").filter(F.col("weight") > 0)
