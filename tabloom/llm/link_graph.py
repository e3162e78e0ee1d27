"""URL filter by rules and, where none fits, by trust that spreads over links between hosts.

Personalised PageRank carries trust from hosts with allowed pages along their links, and distrust
from hosts with blocked pages against the links (who links to bad hosts is suspect). Both start
from the share of a host's pages that the rules allow or block. A host is blocked when its
distrust exceeds its trust. DataFrame operations only.

Mass of hosts without links goes back to the seeds. At the fixed point that scales all trust alike and
all distrust alike, so it is dropped on the way and each kind is scaled to its seeds' sum at the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.sources.work import WorkArea

DAMPING = 0.85
STEPS = 10
#: Without a number of steps, rounds end when they add less than this share of the mass and no host.
CONVERGED = 1e-6
#: Distrust beyond so many times the trust blocks a host.
TOLERANCE = 1.0
#: Trust and distrust this close, relative to trust, are equal, so the order of a sum never decides.
CLOSE = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """`text` is a host and a path, as `example.org/es/`; it fits the host and its subdomains."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        inside = (host == name) | host.endswith("." + name)
        return inside & path.startswith(slash + rest)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, and rule and ruled (its verdict) of the longest fitting rule or null.

    A null url, or one without `://`, has an empty host and path.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(
        "page_id",
        lowered(F.regexp_extract(url, HOST, 1)).alias("host"),
        F.regexp_extract(url, PATH, 1).alias("path"),
    )
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        ruled = F.when(fits, F.lit(r.verdict)).otherwise(ruled)
    return parts.select("*", rule.alias("rule"), ruled.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts; relative links stay on their host."""
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    found = pages.select(
        lowered(F.regexp_extract(url, HOST, 1)).alias("source"),
        F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("link"),
    )
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), F.col("link")))
    target = lowered(F.regexp_extract(F.coalesce(absolute, "link"), HOST, 1))
    found = found.select("source", target.alias("target"))
    found = found.filter("source <> '' AND target <> '' AND source <> target")
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def seeds(pages: DataFrame) -> DataFrame:
    """(kind, host, mass): the shares of a host's judged pages that are allowed and blocked."""
    hosts = pages.filter("host <> ''").groupBy("host").agg(
        *(
            (F.count_if(F.coalesce(F.col("ruled") == v, F.lit(False))) / F.count(F.lit(1))).alias(v)
            for v in ("allow", "block")
        )
    )
    kinds = F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("mass")),
        F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("mass")),
    )
    rows = hosts.select("host", F.explode(kinds).alias("k"))
    return rows.select("k.kind", "host", "k.mass").filter("mass > 0")


def spread(
    links: DataFrame,
    start: DataFrame,
    area: WorkArea,
    damping: float = DAMPING,
    steps: int | None = STEPS,
) -> DataFrame:
    """(host, trust, distrust); each round is written, so lineage stays short.

    `steps` rounds drop the mass of hosts without links. With None, rounds go on until one adds
    less than `CONVERGED` of either kind's mass and reaches no new host, and that mass goes back.
    """
    ways = links.selectExpr("'trust' AS kind", "source AS at", "target AS to", "links").unionByName(
        links.selectExpr("'distrust' AS kind", "target AS at", "source AS to", "links")
    )
    out = ways.groupBy("kind", "at").agg(F.sum("links").alias("out"))
    shares = ways.join(out, ["kind", "at"]).withColumn("share", F.col("links") / F.col("out"))
    shares = area.table(shares.select("kind", "at", "to", "share"), "shares")
    begin = start.withColumn("mass", F.col("mass") * (1 - damping))
    mass = begin
    if not shares.isEmpty():
        totals = {} if steps is not None else _totals(begin)
        for step in itertools.count():
            if step == steps:
                break
            moved = shares.join(mass.withColumnRenamed("host", "at"), ["kind", "at"])
            moved = moved.select(
                "kind", F.col("to").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass")
            )
            summed = begin.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
            mass = area.table(summed, "mass")
            if steps is None:
                before, totals = totals, _totals(mass)
                if all(n == before[k][1] and m - before[k][0] < CONVERGED * m for k, (m, n) in totals.items()):
                    break
        if steps is None:
            mass = _scaled(mass, {k: m / totals[k][0] for k, (m, _) in _totals(start).items()})
    elif steps is None:
        mass = start
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0))
    return mass.groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust"))


def _totals(mass: DataFrame) -> dict[str, tuple[float, int]]:
    """kind -> (mass, hosts)."""
    found = mass.groupBy("kind").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("hosts"))
    return {r["kind"]: (r["mass"], r["hosts"]) for r in found.collect()}


def _scaled(mass: DataFrame, factors: dict[str, float]) -> DataFrame:
    factor = F.lit(1.0)
    for kind, value in factors.items():
        factor = F.when(F.col("kind") == kind, F.lit(value)).otherwise(factor)
    return mass.withColumn("mass", F.col("mass") * factor)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    area: WorkArea,
    damping: float = DAMPING,
    steps: int | None = STEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row.

    A rule's verdict holds where one fits; else that of the host. Without evidence, and for rows
    without a host, the verdict is allow (trust and distrust are 0). Repeated rows and null ids
    stay; an empty table gives an empty result; other columns are not read.
    """
    found = judged(pages, rules)
    start = area.table(seeds(found), "seeds")
    scores = spread(host_links(pages), start, area, damping, steps)
    joined = found.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    worse = F.col("distrust") > F.col("trust") * (tolerance * (1 + CLOSE))
    own = F.when(worse, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust"
    )
