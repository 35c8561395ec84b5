"""URL filters: rules by host and path, and trust that links carry to hosts without one, in DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides.  Every other page gets the verdict of its host: trust starts at hosts in the share of their pages
that rules allow and follows links (personalised PageRank); distrust starts in the share that rules block and follows
links backwards, to the hosts that link there.  A host with more distrust than trust is blocked.  So a host with allowed
and blocked pages goes the way most of them go, and a host that no seed reaches is allowed.

Edges are the links of a page's html to other hosts, weighted by their number among a host's links out (trust) or in
(distrust); relative links and links to the own host are none.  Both ways are one table and take one join a round.
Rounds end when no score changes by TOLERANCE, or after ROUNDS.  Scores are compared at nine places.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows up to `?`, `#` or
the end.  A null url, or one without `://`, has an empty host and path; no rule fits it and it is allowed.  Null or empty
html has no links.  Each row is judged, repeated page_ids too; equal urls fare alike.  Null rules fit nothing, and of
equal rules with different verdicts block holds.  An empty table gives no rows; without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.llm.common import fresh_names, stored

#: (verdict, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS, TOLERANCE = 0.85, 20, 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of a link that names one.
LINK = r"""(?i)<(?:a|area|link|iframe)\b[^>]*?\s(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path and others) with rule and verdict of the longest rule that fits; null where none does."""
    # Rules are looked up once for each different host, by its parents, not for each page.
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.where("host <> ''").select("host").distinct().select("host", F.explode(parents).alias("at"))
    name = F.concat("host", "path")
    # Longest first; of equal rules block.
    table = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    table = table.select(F.col("host").alias("at"), F.struct((-F.length(name)).alias("order"), name.alias("rule"), "path", "verdict").alias("rule"))
    # Written, so that the join's sides are plain and Spark can split the pages of a host that has very many.
    fitting = stored(hosts.join(table, "at").groupBy("host").agg(F.sort_array(F.collect_list("rule")).alias("_rules")), "fitting")
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return urls.join(fitting, "host", "left").withColumn("_first", first).withColumns({"rule": F.col("_first.rule"), "verdict": F.col("_first.verdict")}).drop("_rules", "_first")


def host_links(pages: DataFrame) -> DataFrame:
    """(host, target, n): how many links lead from host to another host."""
    host, _ = host_and_path(F.col("url"))
    found = pages.where("html is not null").select(host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("target"))
    found = found.select("host", F.translate("target", UPPER, LOWER).alias("target")).where("host <> '' and host <> target")
    return found.groupBy("host", "target").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): trust along (host, target, n) and distrust against it, from seeds (kind, host, mass).

    Every round's scores are written, so a lost executor costs its tasks and plans stay short.
    """
    forth = links.select(F.lit("trust").alias("kind"), "host", "target", "n")
    back = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("host").alias("target"), "n")
    both = forth.union(back)
    whole = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    edges = stored(both.join(whole, ["kind", "host"]).select("kind", "host", "target", (F.col("n") / F.col("all")).alias("share")), "edges")
    source = stored(seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("score")), "seeds")
    scores = source
    for _ in range(0 if edges.isEmpty() else rounds):
        # The score of a host stands beside the one before, negated, for the change.
        carried = edges.join(scores, ["kind", "host"]).select("kind", F.col("target").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        fresh = source.union(carried).withColumn("old", F.lit(0.0)).union(scores.select("kind", "host", F.lit(0.0), "score"))
        now = stored(fresh.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")), "scores")
        scores = now.select("kind", "host", "score")
        change = now.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        if change is None or change <= tolerance:  # None: no seed at all
            break
    return scores


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of pages (page_id, url, html).

    trust and distrust are those of the host.
    """
    host, path = host_and_path(F.col("url"))
    urls = stored(_ruled(pages.select("page_id", host.alias("host"), path.alias("path")), rules), "ruled")
    share = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, 1).otherwise(0)) / F.count("*")
    hosts = urls.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select("host", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("mass")) for k in ("trust", "distrust")]))).where("mass > 0")
    scores = propagate(host_links(pages), seeds)
    by_host = scores.groupBy("host").agg(*[F.round(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)), 9).alias(k) for k in ("trust", "distrust")])
    by_host = stored(by_host, "by_host")
    trust, distrust = (F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust"))
    method = F.when(distrust > trust, "block").otherwise("allow")
    return urls.join(by_host, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of pages whose url is allowed, with all their columns whatever their names."""
    url, verdict = fresh_names(pages, "url_key", "verdict")
    # A url's verdict is the same in all its rows; null urls are allowed.
    found = judged(pages.select(F.col("url").alias("page_id"), "url", "html"), rules).where("verdict = 'block'").select(F.col("page_id").alias(url)).distinct()
    return pages.join(found, F.col("url") == F.col(url), "left_anti")


def report(pages: DataFrame, rules: DataFrame) -> DataFrame:
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")
