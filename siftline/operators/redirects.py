"""Redirect resolution and URL safety over a crawl log instead of live requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from siftline.functions.net import IPV4, is_blocked_ip, url_rejection
from siftline.functions.urls import url_host
from siftline.operators.skew import lookup_join
from siftline.session import materialize

# Statuses followed when a location is given, and the hop limit.
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 5


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, location: pd.Series) -> pd.Series:
    """Resolve a Location header against the URL it came from."""
    from urllib.parse import urljoin

    return pd.Series(
        [None if b is None or x is None else urljoin(b, x) for b, x in zip(base, location)], dtype=object
    )


def host_verdicts(dns: DataFrame) -> DataFrame:
    """host, blocked_ip: null when every resolved address is public."""
    checked = dns.select(F.lower("host").alias("host"), "ip", is_blocked_ip("ip").alias("blocked"))
    return checked.groupBy("host").agg(F.min(F.when(F.col("blocked"), F.col("ip"))).alias("blocked_ip"))


def url_safety(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """url, problem: null when the URL may be fetched.

    ``urls`` has distinct URLs; a literal address is judged as it stands and needs no
    lookup. A host that does not resolve is refused.
    """
    parsed = urls.select("url", url_host("url").alias("host"), url_rejection("url").alias("refused"))
    literal = F.col("host").rlike(IPV4) | F.col("host").contains(":")
    verdicts = host_verdicts(dns).withColumn("resolved", F.lit(True))
    joined = lookup_join(parsed, verdicts, ["host"])
    inner = F.when(is_blocked_ip(F.when(literal, F.col("host"))), F.col("host")).when(~literal, F.col("blocked_ip"))
    problem = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(inner.isNotNull(), F.concat(F.col("host"), F.lit(" resolves to disallowed address "), inner))
        .when(~literal & F.col("resolved").isNull(), F.concat(F.lit("DNS resolution failed for "), F.col("host")))
    )
    return joined.select("url", problem.alias("problem"))


def crawl_outcomes(hops: DataFrame) -> DataFrame:
    """One outcome per crawled URL: url, outcome (redirect/ok/timeout/error), target, detail.

    Where a log has several rows for a URL, a refused method (405) gives way to the retry.
    """
    one = hops.groupBy("url").agg(
        F.min(F.struct(F.coalesce(F.col("status") == 405, F.lit(False)).alias("retry"), "status", "location", "error")).alias("h")
    )
    follow = F.col("h.status").isin(*REDIRECT_STATUSES) & F.col("h.location").isNotNull()
    timed_out = F.lower(F.col("h.error")).contains("timeout")
    return one.select(
        "url",
        F.when(F.col("h.error").isNotNull(), F.when(timed_out, "timeout").otherwise("error"))
        .when(F.coalesce(follow, F.lit(False)), "redirect")
        .otherwise("ok")
        .alias("outcome"),
        F.when(F.coalesce(follow, F.lit(False)) & F.col("h.error").isNull(), F.col("h.location")).alias("location"),
        F.col("h.error").alias("detail"),
    ).withColumn("target", join_url("url", "location")).drop("location")


def resolve_redirects(
    urls: DataFrame, hops: DataFrame, dns: DataFrame, *, max_redirects: int = MAX_REDIRECTS
) -> DataFrame:
    """Follow each distinct URL through the log.

    ``urls``: url; ``hops``: url, status, location, error; ``dns``: host, ip. Output:
    original_url, final_url, redirect_chain, status (ok, blocked_ssrf,
    too_many_redirects, timeout, error), error. Every URL is judged once, then at most
    ``max_redirects + 1`` rounds join the walkers still on their way; finished walkers
    leave the loop. Each round is written to the checkpoint folder.
    """
    outcomes = materialize(crawl_outcomes(hops))
    start = materialize(urls.select("url").filter(F.col("url").isNotNull()).distinct())
    universe = start.unionByName(outcomes.select(F.col("target").alias("url")).filter(F.col("url").isNotNull())).distinct()
    steps = materialize(url_safety(universe, dns).join(outcomes, "url", "left"))
    walkers = start.select(
        F.col("url").alias("original_url"), F.col("url").alias("current"),
        F.array().cast("array<string>").alias("chain"),
    )
    done = []
    for _ in range(max_redirects + 1):
        at = steps.withColumnRenamed("url", "current")
        moved = materialize(lookup_join(walkers, at, ["current"], how="inner"))
        blocked = F.col("problem").isNotNull()
        visited = F.concat("chain", F.array("current"))
        outcome = F.coalesce("outcome", F.lit("error"))
        ended = moved.filter(blocked | (outcome != "redirect"))
        done.append(
            ended.select(
                "original_url", F.col("current").alias("final_url"),
                F.when(blocked, F.col("chain")).otherwise(visited).alias("redirect_chain"),
                F.when(blocked, "blocked_ssrf").otherwise(outcome).alias("status"),
                F.when(blocked, F.col("problem"))
                .when(F.col("outcome").isNull(), "no crawl record")
                .otherwise(F.col("detail"))
                .alias("error"),
            )
        )
        walkers = moved.filter(~blocked & (outcome == "redirect")).select(
            "original_url", F.col("target").alias("current"), visited.alias("chain")
        )
        if walkers.isEmpty():
            break
    done.append(
        walkers.select(
            "original_url", F.col("current").alias("final_url"), F.col("chain").alias("redirect_chain"),
            F.lit("too_many_redirects").alias("status"), F.lit(None).cast("string").alias("error"),
        )
    )
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
