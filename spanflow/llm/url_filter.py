"""URL filter by rules and link-graph propagation.

Rules name a host (with its subdomains) and a path prefix, and the longest that
fits a url decides.  Where none fits, its host does: trust starts at the hosts with
allowed pages and flows along links (personalised PageRank), distrust starts at
those with blocked pages and flows against them, since who links to bad hosts is
suspect.  A host is blocked if distrust is more than the threshold's part of both.

Link rows are added up to host edges before anything is joined, so a host with a
third of all pages is one row of the graph; the page table is joined with one
row per host, a join that Spark splits on the page side.  Ranks are written to the
shared folder after every round.  Rounds go on until the ranks change by less than
``TOLERANCE`` in all and no host is reached for the first time, so every host that links
lead to has its part, however long the way (a part as small as doubles go).

Defined cases: a NULL url, or one without ``://``, has an empty host and path and no
rule fits it; the empty host is never a node, its pages get the verdict of an
unknown host; NULL html has no links; links without a host of their own are links
of a host to itself and carry nothing; repeated rows count as pages of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stored

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block")]
DAMPING = 0.85
#: Of the summed change of both ranks in a round, each of which adds up to 1 at most.
#: Damping bounds the rounds to that, log(TOLERANCE / 4) / log(DAMPING), about 137.
TOLERANCE = 1e-9
THRESHOLD = 0.5
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (NULL where none does)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts."""
    links = F.explode(F.regexp_extract_all(quoted(html), F.lit(_LINK), F.lit(1)))
    rows = pages.select(host_of(quoted(url)).alias("src"), links.alias("link"))
    rows = rows.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[^/]*", ""))).alias("dst"))
    rows = rows.where("src != '' AND dst != '' AND src != dst")
    return rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust) and edges (src,
    dst, n): until the ranks stand, or a fixed number of rounds if one is given."""
    edges = stored(edges, "host_edges")
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("n_in"))
    nodes = (seeds.select("host", "trust", "distrust")
             .union(edges.select("src", F.lit(0.0), F.lit(0.0)).distinct()).union(edges.select("dst", F.lit(0.0), F.lit(0.0)).distinct())
             .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    total = nodes.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    nodes = nodes.select("host", (F.col("trust") / F.lit(total.t or 1.0)).alias("trust0"),
                         (F.col("distrust") / F.lit(total.d or 1.0)).alias("distrust0"))
    nodes = stored(nodes.join(out, "host", "left").join(into, "host", "left"), "hosts")
    ranks = nodes.withColumn("trust", F.col("trust0")).withColumn("distrust", F.col("distrust0"))
    if edges.isEmpty():  # nothing flows: the seeds are the ranks
        return ranks.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    for k in count():
        if k == rounds:
            break
        own = ranks.select("host", (F.col("trust") / F.col("n_out")).alias("give"), (F.col("distrust") / F.col("n_in")).alias("blame"))
        along = edges.join(own.withColumnRenamed("host", "src"), "src").select(
            F.col("dst").alias("host"), (F.col("give") * F.col("n")).alias("t"), F.lit(0.0).alias("d"))
        against = edges.join(own.withColumnRenamed("host", "dst"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0), (F.col("blame") * F.col("n")))
        got = along.union(against).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        before = ranks.select(*nodes.columns, F.col("trust").alias("trust_before"), F.col("distrust").alias("distrust_before"))
        new = before.join(got, "host", "left")
        ranks = stored(new.select(
            *nodes.columns, "trust_before", "distrust_before", (F.lit(1 - damping) * F.col("trust0") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.lit(1 - damping) * F.col("distrust0") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust")), "ranks")
        if rounds is None:
            change = sum(F.abs(F.col(x) - F.col(f"{x}_before")) for x in ("trust", "distrust"))
            reached = F.greatest(*[((F.col(x) > 0) & (F.col(f"{x}_before") == 0)).cast("int") for x in ("trust", "distrust")])
            left = ranks.agg(F.sum(change).alias("change"), F.max(reached).alias("reached")).first()
            if left.change < tolerance and not left.reached:
                break
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
          threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int | None = None,
          tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, url, host, path, rule, verdict (allow or block), and the host's
    trust, distrust and suspicion (distrust's part of both; NULL if unknown)."""
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"), host_of(quoted(url)).alias("host"),
                        path_of(quoted(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    seeds = ruled.where("verdict IS NOT NULL AND host != ''").groupBy("host").agg(
        F.sum((F.col("verdict") == "allow").cast("double")).alias("trust"),
        F.sum((F.col("verdict") == "block").cast("double")).alias("distrust"))
    ranks = propagate(seeds, host_edges(pages, url, html), damping, rounds, tolerance)
    # the same scale for both: a host's part of all trust, and of all distrust
    both = F.col("trust") + F.col("distrust")
    ranks = ranks.withColumn("suspicion", F.when(both > 0, F.col("distrust") / both))
    method = F.when(F.col("suspicion") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(ranks, "host", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"),
                                                    "trust", "distrust", "suspicion")


def allowed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **how) -> DataFrame:
    """The pages whose url is allowed, with their own columns only."""
    name = fresh("blocked_url_", pages.columns)
    blocked = judge(pages, page_id, url, html, **how).where("verdict = 'block'").select(F.col("url").alias(name)).distinct()
    return pages.join(blocked, quoted(url) == F.col(name), "left_anti")
