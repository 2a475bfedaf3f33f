"""URL filter by link-graph propagation (operator 6, DataFrame and SQL functions only).

Rules decide the urls they fit (longest rule first). For the rest, hosts are judged by the link
graph: personalised PageRank spreads trust from hosts whose pages an allow rule fits along the
links; distrust runs against them, from hosts whose pages a block rule fits to those who link
there (a host's distrust is the chance that a walk from it, along its links, ends at a blocked
seed). A host's seed is the share of its pages that the rules decide so, and its scores are at
least its seeds. Per host, the verdict is block where distrust reaches ``threshold`` and exceeds
trust, else allow.

Edges are the absolute ``href`` targets of the html, weighted by their number; each page adds a
link of its host to itself (its relative navigation). Edges are summed per host pair before
they are joined, so a host that holds a third of all pages is a few rows; its pages meet its
verdict in a salted join. Iterations are checkpointed every ``CUT`` rounds.

Cases: a url that is null or has no ``://`` has empty host and path, fits no rule and belongs to
no host: its verdict is allow. Null html has no links; repeated rows count again; hosts that are
only linked to take part in the graph; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitio.llm.common import salted_join
from transitio.session import materialize

#: Fixed values of the contract: (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
HREF = r"""[Hh][Rr][Ee][Ff]\s*=\s*["']?(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
ROUNDS = 10
CUT = 5
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits; of equally long ones block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules, id_col: str, url_col: str) -> DataFrame:
    df = pages.withColumn("host", host_and_path(F.col(url_col))[0]).withColumn("path", host_and_path(F.col(url_col))[1])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


def host_edges(df: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, n): links between hosts, the own host of each page once."""
    linked = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1))
    return df.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.concat(F.array("host"), F.transform(
        linked, lambda h: F.translate(h, UPPER, LOWER)))).alias("dst")) \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """Personalised PageRank of ``edges`` (kind, src, dst, w) from ``seeds`` (kind, host, seed):
    (kind, host, seed, x) after ``rounds`` rounds, started at the seeds."""
    x = seeds.select("kind", "host", "seed", F.col("seed").alias("x"))
    for i in range(rounds):
        sent = edges.join(x.select("kind", F.col("host").alias("src"), "x"), ["kind", "src"]) \
            .groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("x") * F.col("w")).alias("got"))
        x = seeds.join(sent, ["kind", "host"], "left").select(
            "kind", "host", "seed", (F.col("seed") * (1 - damping) + F.coalesce("got", F.lit(0.0)) * damping).alias("x"))
        if i % CUT == CUT - 1:
            x = materialize(x)
    return x.select("kind", "host", "seed", "x")


def host_scores(df: DataFrame, html_col: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host of ``df`` (judged pages) and of their links."""
    edges = materialize(host_edges(df, html_col))
    out = edges.groupBy("src").agg(F.sum("n").alias("t"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("t")).alias("w"))
    forward = shares.select(F.lit("trust").alias("kind"), "src", "dst", "w")
    back = shares.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    share = df.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct().join(share, "host", "left")
    seeds = hosts.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.coalesce("trust", F.lit(0.0)).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), F.coalesce("distrust", F.lit(0.0)).alias("seed")))).alias("s")) \
        .select("s.kind", "host", "s.seed")
    x = propagate(materialize(forward.unionByName(back)), materialize(seeds), damping, rounds)
    of = {k: F.max(F.when(F.col("kind") == k, F.greatest("seed", "x"))) for k in ("trust", "distrust")}
    return x.groupBy("host").agg(*[F.round(v, 6).alias(k) for k, v in of.items()])


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """id, host, path, rule, verdict and the host's trust and distrust, one row per row of ``pages``."""
    df = judged(pages.select(id_col, url_col, html_col), rules, id_col, url_col)
    scores = host_scores(df, html_col, damping, rounds)
    rows = salted_join(df.select(id_col, "host", "path", "rule", "ruled"), scores, ["host"], F.col(id_col))
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce(
        "ruled", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
