"""Robots policies: reading the files (X14) and checking URLs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import head_bytes, let, trim_space
from webloom.functions.urls import host_of, path_of

BODY_CAP = 1024 * 1024
_POLICY = "struct<mine:boolean,allow:array<string>,disallow:array<string>,delay:double>"


def robots_policy(body: Column, agent: str = "webloom") -> Column:
    """STRUCT<allow, disallow, delay> of the groups for '*' or the crawler's own token.

    One fold over the lines of a file of at most 1 MiB. Groups are merged, the last user-agent line
    decides whose group it is, text after '#' is a comment.
    """
    capped = F.when(F.octet_length(body) > BODY_CAP, head_bytes(body, BODY_CAP)).otherwise(body)

    def directive(line: Column) -> Column:
        text = trim_space(F.substring_index(line, "#", 1))
        return F.struct(
            F.when(text.contains(":"), F.lower(trim_space(F.substring_index(text, ":", 1)))).alias("key"),
            trim_space(F.regexp_extract(text, r"(?s)^[^:]*:(.*)\z", 1)).alias("val"),
        )

    def step(acc: Column, d: Column) -> Column:
        names_us = (d["val"] == "*") | (F.lower(d["val"]) == agent.lower())
        mine = F.when(d["key"] == "user-agent", names_us).otherwise(acc["mine"])
        seconds = F.when(d["val"].rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), d["val"].try_cast("double"))

        def added(kind: str) -> Column:
            return F.when(acc["mine"] & (d["key"] == kind), F.concat(acc[kind], F.array(d["val"]))).otherwise(acc[kind])

        return F.struct(
            F.coalesce(mine, acc["mine"]).alias("mine"),
            added("allow").alias("allow"),
            added("disallow").alias("disallow"),
            F.when(acc["mine"] & (d["key"] == "crawl-delay"), F.coalesce(seconds, acc["delay"]))
            .otherwise(acc["delay"])
            .alias("delay"),
        )

    # Only the lines that matter are folded, so the arrays grow by rule and not by line.
    lines = F.filter(
        F.transform(F.split(capped, r"\r?\n"), directive),
        lambda d: F.coalesce(d["key"].isin("user-agent", "allow", "disallow", "crawl-delay"), F.lit(False)),
    )
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit(False).alias("mine"), empty.alias("allow"), empty.alias("disallow"), F.lit(0.0).alias("delay")
    ).cast(_POLICY)
    return let(F.aggregate(lines, start, step), lambda p: F.struct(p["allow"], p["disallow"], p["delay"]))


def policy_rows(robots: DataFrame, agent: str = "webloom") -> DataFrame:
    """(host, kind, prefix, delay) rows of robots files."""
    policies = robots.select("host", robots_policy(F.col("body"), agent).alias("p"))

    def entries(kind: str) -> Column:
        return F.transform(F.col(f"p.{kind}"), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("prefix")))

    return policies.select(
        "host", F.explode(F.concat(entries("allow"), entries("disallow"))).alias("r"), F.col("p.delay").alias("delay")
    ).select("host", "r.kind", "r.prefix", "delay")


def _longest(prefixes: Column, path: Column) -> Column:
    hits = F.filter(prefixes, lambda p: (p != "") & ((p == "/") | F.startswith(path, p)))
    return F.coalesce(F.array_max(F.transform(hits, F.octet_length)), F.lit(0))


def path_allowed(path: Column, policy: Column) -> Column:
    """The longest matching allow prefix must beat the longest matching disallow prefix."""
    return let(
        F.struct(_longest(policy["disallow"], path).alias("no"), _longest(policy["allow"], path).alias("yes")),
        lambda m: (m["no"] == 0) | (m["yes"] > m["no"]),
    )


def check_robots(urls: DataFrame, robots: DataFrame, agent: str = "webloom") -> DataFrame:
    """URLs with ``allowed`` and the crawl delay of their host (J4); hosts without a file allow all.

    A host has one policy row of bounded size, so the join is many-to-one: a URL meets its host's
    prefixes inside one row and no URL-prefix pairs are produced. A hot host is split by the skew join.
    """
    policies = robots.select(F.lower("host").alias("_host"), robots_policy(F.col("body"), agent).alias("_policy"))
    keyed = urls.withColumn("_host", host_of(F.col("url")))
    return (
        keyed.join(policies, "_host", "left")
        .withColumn("allowed", F.coalesce(path_allowed(path_of(F.col("url")), F.col("_policy")), F.lit(True)))
        .withColumn("delay", F.coalesce(F.col("_policy.delay"), F.lit(0.0)))
        .drop("_host", "_policy")
    )
