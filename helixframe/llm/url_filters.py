"""URL filters: longest-match rules, and for the rest trust and distrust that spread over links between hosts.

Personalised PageRank from trusted hosts follows links; distrust from blocked hosts follows them backwards, to those that link to blocked
hosts.  Both start from seeds: a host that fits a block rule for whole hosts, and a host with an allowed page that is no such host.  What
reaches a host without links on goes back to the seeds.  Rounds go on until what is still to come is under `tolerance` shares of a
seed in all, at any distance from the seeds.  A host is blocked if its distrust is at least `threshold` of a seed's own share
and more than its trust, both measured in such shares.

DataFrame functions only.  Links are counted for each pair of hosts before any shuffle joins them; joins on a host are plain ones that
adaptive execution can split.

Cases: a null URL, or one without ://, has an empty host and path, fits no rule and is judged like a host without links: allowed.  Null
html has no links.  Repeated rows are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import columns_of, prepare, save

_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _fits_host(host: Column, name: str) -> Column:
    return (host == name) | host.endswith("." + name)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, start = _split(rule)
        out = F.when(_fits_host(host, name) & path.startswith(start), F.lit(rule)).otherwise(out)
    return out


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, look_every: int = 4) -> DataFrame:
    """(host, kind, x): PageRank of each kind in shares of a seed's teleport.  links (kind, src, dst, n) and seeds (kind, host) are distinct.

    Each round shrinks the sum of all changes to `damping` of it at most, so what is to come after a change c is under c * damping /
    (1 - damping), and the number of rounds is bounded by the logarithm of the number of seeds.
    """
    sizes = {r["kind"]: r["size"] for r in seeds.groupBy("kind").agg(F.count("*").alias("size")).collect()}  # a row for each kind
    of_kind = lambda values: reduce(lambda out, k: F.when(F.col("kind") == k, F.lit(float(values[k]))).otherwise(out), sorted(values), F.lit(1.0))
    out_of = links.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    flow = save(links.join(out_of, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "flow")
    seeds = save(seeds.select("kind", "host", (1 / of_kind(sizes)).alias("seed")), "seeds")
    share = {k: n / (1 - damping) for k, n in sizes.items()}
    most = math.ceil(math.log(tolerance * (1 - damping) / (2 * max(share.values(), default=1.0))) / math.log(damping)) + 1
    now = seeds.withColumnRenamed("seed", "x")
    for i in range(1, most + 1):
        got = now.withColumnRenamed("host", "src").join(flow, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("x") * F.col("w"))).alias("got"))
        parts = [got.select("kind", "host", "got", F.lit(0.0).alias("seed"), F.lit(0.0).alias("was")), seeds.select("kind", "host", F.lit(0.0), "seed", F.lit(0.0)), now.select("kind", "host", F.lit(0.0), F.lit(0.0), "x")]
        part = reduce(DataFrame.unionAll, parts).groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ("got", "seed", "was")])
        part = save(part, "ranks")
        rest = {r["kind"]: r["rest"] for r in part.groupBy("kind").agg((1 - F.sum("got")).alias("rest")).collect()}  # a row for each kind
        new = part.select("kind", "host", (F.col("got") + of_kind(rest) * F.col("seed")).alias("x"), "was")
        now = new.drop("was")
        if i == 1 or i % look_every == 0:
            change = new.groupBy("kind").agg(F.sum(F.abs(F.col("x") - F.col("was"))).alias("change")).collect()  # a row for each kind
            if all(r["change"] * share[r["kind"]] * damping / (1 - damping) < tolerance for r in change):
                break
    return now.select("host", "kind", (F.col("x") * of_kind(share)).alias("x"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, **options) -> DataFrame:
    """Returns id_col, host, path, rule and verdict, one row for each input row.  rules: (allow or block, host/path)."""
    prepare(pages.sparkSession)
    rows = columns_of(pages, id=id_col, url=url_col, html=html_col)
    url = F.coalesce("url", F.lit(""))
    judged = rows.select("id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    judged = judged.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r for a, r in rules if a == "allow"])
    whole = reduce(lambda x, y: x | y, [_fits_host(F.col("host"), _split(r)[0]) for a, r in rules if a == "block" and _split(r)[1] in ("", "/")], F.lit(False))

    named = judged.where("host != ''")
    hosts = named.groupBy("host").agg(F.max(allowed.cast("int")).alias("allowed"), F.max(whole.cast("int")).alias("blocked"))
    seeds = hosts.where("blocked = 1").select(F.lit("distrust").alias("kind"), "host").unionAll(hosts.where("blocked = 0 AND allowed = 1").select(F.lit("trust").alias("kind"), "host"))
    found = named.where(F.col("html").isNotNull()).select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    edges = save(found.select("host", lower_ascii(F.col("to")).alias("to")).where("host != to").groupBy("host", "to").agg(F.count("*").alias("n")), "edges")
    links = edges.select(F.lit("trust").alias("kind"), F.col("host").alias("src"), F.col("to").alias("dst"), "n").unionAll(edges.select(F.lit("distrust"), "to", "host", "n"))
    ranks = spread(links, seeds, **options).groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("x"))), F.lit(0.0)).alias("distrust"), F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("x"))), F.lit(0.0)).alias("trust")
    )
    bad = ranks.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("by_links"))
    by_rule = F.when(F.col("rule").isNull(), None).when(allowed, F.lit("allow")).otherwise(F.lit("block"))
    out = judged.drop("html").join(bad, "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, "by_links", F.lit("allow")).alias("verdict"))
