"""URL filters by rules, and by trust that spreads over links between hosts.

Hosts whose pages a rule allows are trusted, hosts whose pages a rule blocks
are distrusted, each by the share of their pages; of a host without pages, the
targets of the links to it count instead. Trust follows links (a page
vouches for what it links to), distrust follows them backwards (who links to
bad hosts is suspect). Both are personalised PageRanks over the host graph. A
host is blocked when its distrust exceeds its trust by the threshold.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored

# Steps end when one moves no more than this share of the seeds, of trust and of distrust.
DAMPING, ENOUGH = 0.85, 1e-6
# Host and path of an absolute link, with or without a scheme.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+(?:/[^?#"'\s>]*)?)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for NULL and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, else NULL. A rule ``host/path`` holds for subdomains, too."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def target_host(target: Column) -> Column:
    return lower_ascii(F.regexp_extract(target, "^[^/]*", 0))


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: pages of ``src`` that link to ``dst``. Pages of a hot host are counted on the map side."""
    found = pages.select("host", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("html", F.lit(LINK), 1), target_host))).alias("dst"))
    return found.where("host <> '' AND dst <> host").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def target_seeds(pages: DataFrame, hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(host, n, trust, distrust)`` of linked hosts that are not in ``hosts``: different targets, and those that rules allow and block."""
    found = pages.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("target"))
    found = found.select(F.col("host").alias("src"), target_host(F.col("target")).alias("host"), F.regexp_extract("target", "^[^/]*(.*)", 1).alias("path"))
    targets = found.where("src <> host").select("host", "path").distinct().join(hosts.select("host"), "host", "left_anti")
    return counted(targets.withColumn("verdict", matched_rule(F.col("host"), F.col("path"), rules)["verdict"]))


def counted(pages: DataFrame) -> DataFrame:
    """``(host, n, trust, distrust)``: pages of each host, and those that rules allow and block."""
    return pages.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("verdict") == "allow").cast("int")).alias("trust"),
        F.sum((F.col("verdict") == "block").cast("int")).alias("distrust"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, steps: int | None = None, enough: float = ENOUGH) -> DataFrame:
    """``(kind, host, score)`` from ``seeds (kind, host, seed)`` and ``links (src, dst, n)``.

    Kind ``trust`` follows links, kind ``distrust`` goes against them:
    ``score = (1 - damping) * seed + damping * sum of score * share of the link``.
    Each step is one join and one sum over the links, and is written to the
    shared folder. It ends when scores move by no more than ``enough`` times the
    sum of their kind's seeds, which comes to pass as a step moves at most ``damping``
    times what the one before moved; or after ``steps``, where they are given.
    """
    ways = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    totals = ways.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    ways = stored(ways.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total")).alias("share")), "ways")
    own = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    own = stored(own, "seeds")
    scores = own
    limits = {r["kind"]: enough * r["seed"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("seed")).collect()}
    for _ in itertools.count() if steps is None else range(steps):
        sent = scores.join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        new = stored(own.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
        both = new.select("kind", "host", "score").unionByName(scores.select("kind", "host", (-F.col("score")).alias("score")))
        moved = both.groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d")).groupBy("kind").agg(F.sum("d").alias("d")).collect()
        scores = new
        if all(r["d"] <= limits[r["kind"]] for r in moved):
            break
    return scores


def host_verdicts(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 1.0) -> DataFrame:
    """``(host, trust, distrust, blocked)`` from ``pages (host, html, verdict)``, verdicts being those of ``rules``."""
    hosts = stored(counted(pages), "hosts")
    known = hosts.unionByName(target_seeds(pages, hosts, rules))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.coalesce(k, F.lit(0)) / F.col("n")).alias("seed")) for k in ("trust", "distrust")])
    seeds = known.select("host", F.inline(kinds)).where("seed > 0")
    scores = spread(seeds, host_links(pages))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return scores.groupBy("host").agg(*sums).withColumn("blocked", F.col("distrust") > F.col("trust") * threshold)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 1.0) -> DataFrame:
    """One row per page: ``(page_id, host, path, rule, verdict)``.

    Rules ``(verdict, host/path)`` come first, the longest that fits. Where
    none does, the host's trust decides; without distrust a page is allowed,
    and so are pages without a host. NULL html has no links. Equal and repeated
    rows are judged alike. Other columns are ignored, an empty table stays empty.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rows = rows.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "html", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    # Only blocked hosts are looked up, one row each.
    blocked = stored(host_verdicts(rows, rules, threshold).where("blocked").select("host", F.lit("block").alias("by_links")), "blocked")
    return rows.drop("html").join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "by_links", F.lit("allow")).alias("verdict"))
