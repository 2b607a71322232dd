"""URL filter: rules first, then the likelihood ratio of two character models.

URLs that a rule decides train two Markov models of variable order over the
characters of host and path, one of accepted and one of rejected URLs. A model
blends the orders from 0 to ORDER by how many different characters it has seen
after a context (Witten-Bell), down to a uniform share. Other URLs are accepted
when the difference of their log-likelihoods for each character reaches a
threshold. It is calibrated on the URLs of the rules, each scored by models that
have not seen its half; the others take the mean of both halves' models.

Everything is built from DataFrame functions. Scores are summed as whole
millionths, so they do not depend on the order of rows.

A null URL, or one without ``://``, has an empty host and path; no rule fits it,
and it is scored as the empty text. Equal host and path get equal verdicts,
whatever page_id (null, repeated) they come with. Without URLs on both sides the
models cannot part anything, and URLs without a rule are accepted.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import written

ORDER = 4
# Possible characters, for the share of one that was never seen.
ALPHABET = 256
#: Fixed rules: a verdict, a host and a path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_BEGIN, _END = "\u0002", "\u0003"
_UNIT = 1_000_000
# Cells of the score histogram that the threshold is read from, and its reach.
_CELLS, _REACH = 4096, 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, site, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        rule = F.when(fits, F.lit(site + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _grams(rows: DataFrame) -> DataFrame:
    """Each row once for each character of ``body`` and its end: the character after its context."""
    padded = F.concat(F.lit(_BEGIN * ORDER), F.col("body"), F.lit(_END))
    places = F.sequence(F.lit(1), F.length("body") + 1)
    return rows.withColumn("padded", padded).select(
        *rows.columns,
        F.explode(F.transform(places, lambda at: F.substring(F.col("padded"), at, F.lit(ORDER + 1)))).alias("gram"),
    )


# One counter for each class and half that the model leaves out.
_MODELS = [(word, half) for word in ("allow", "block") for half in (0, 1)]
_COUNTS = [f"{word}_{half}" for word, half in _MODELS]


def gram_counts(bodies: DataFrame) -> DataFrame:
    """(gram, counts): how often each gram stands in the URLs that each model learns from."""
    seen = _grams(bodies)
    return seen.groupBy("gram").agg(
        *[
            F.count_if((F.col("verdict") == word) & (F.col("half") != half)).alias(name)
            for (word, half), name in zip(_MODELS, _COUNTS)
        ]
    )


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio_0, ratio_1): log-likelihood differences in millionths, for either left-out half."""
    known = grams
    shares = {name: F.lit(1.0 / ALPHABET) for name in _COUNTS}
    for order in range(ORDER + 1):
        tail, context = f"tail_{order}", f"context_{order}"
        known = known.withColumn(tail, F.right("gram", F.lit(order + 1))).withColumn(
            context, F.expr(f"left(right(gram, {order + 1}), {order})")
        )
        # Each order stands on a table: the plan would grow with every reuse of the one before.
        known = written(known, "order")
        level = known.groupBy(tail, context).agg(*[F.sum(name).alias(f"n_{name}") for name in _COUNTS])
        total = level.groupBy(context).agg(
            *[F.sum(f"n_{name}").alias(f"all_{name}") for name in _COUNTS],
            *[F.count_if(F.col(f"n_{name}") > 0).alias(f"kinds_{name}") for name in _COUNTS],
        )
        known = known.join(level.drop(context), tail).join(total, context)
        for name in _COUNTS:
            all_of, kinds = F.col(f"all_{name}"), F.col(f"kinds_{name}")
            blended = (F.col(f"n_{name}") + kinds * shares[name]) / (all_of + kinds)
            known = known.withColumn(f"p_{name}", F.when(all_of > 0, blended).otherwise(shares[name]))
        known = known.select(*grams.columns, *[f"p_{name}" for name in _COUNTS])
        shares = {name: F.col(f"p_{name}") for name in _COUNTS}
    known = written(known, "order")
    ratio = lambda half: F.round((F.log(f"p_allow_{half}") - F.log(f"p_block_{half}")) * _UNIT).cast("long")
    return known.select("gram", ratio(0).alias("ratio_0"), ratio(1).alias("ratio_1"))


def scored(bodies: DataFrame) -> DataFrame:
    """Distinct bodies with ``score_0`` and ``score_1``: the mean difference for each character, in millionths."""
    ratios = written(log_ratios(written(gram_counts(bodies), "grams")), "ratios")
    sums = (
        _grams(bodies.select("body"))
        .join(ratios, "gram")
        .groupBy("body")
        .agg(F.sum("ratio_0").alias("sum_0"), F.sum("ratio_1").alias("sum_1"))
    )
    size = F.length("body") + 1
    return bodies.join(sums, "body").select(
        *bodies.columns, (F.col("sum_0") / size).alias("score_0"), (F.col("sum_1") / size).alias("score_1")
    )


def threshold(scores: DataFrame) -> float:
    """The cell border that parts accepted and rejected URLs with the fewest errors.

    Either class weighs the same; of equal borders the middle one counts. At most
    two counts for each cell reach the driver.
    """
    own = F.when(F.col("half") == 0, F.col("score_0")).otherwise(F.col("score_1"))
    cell = F.floor((own / _UNIT + _REACH) * (_CELLS / (2 * _REACH)))
    cell = F.least(F.greatest(cell, F.lit(0)), F.lit(_CELLS - 1)).cast("int")
    table = scores.where("verdict IS NOT NULL").groupBy("verdict", cell.alias("cell")).count().collect()
    counts = {"allow": np.zeros(_CELLS + 1), "block": np.zeros(_CELLS + 1)}
    for row in table:
        counts[row["verdict"]][row["cell"] + 1] += row["count"]
    good, bad = counts["allow"], counts["block"]
    if not good.sum() or not bad.sum():
        return float("-inf")
    errors = np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum()
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return (float(best[len(best) // 2]) * (2 * _REACH / _CELLS) - _REACH) * _UNIT


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page; ``score`` in log units, null under a rule."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    body = F.concat("host", "path")
    bodies = (
        rows.select("host", "path")
        .distinct()
        .select(body.alias("body"), "host", "path", verdict.alias("verdict"))
        .withColumn("half", F.pmod(F.xxhash64("body"), F.lit(2)))
    )
    scores = written(scored(bodies), "scores")
    least = threshold(scores)
    mean = (F.col("score_0") + F.col("score_1")) / 2
    judged = scores.select(
        "host",
        "path",
        F.coalesce("verdict", F.when(mean >= F.lit(least), F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        F.when(F.col("verdict").isNull(), mean / _UNIT).alias("score"),
    )
    return rows.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), "verdict", "score"
    )


def op4_markov_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
