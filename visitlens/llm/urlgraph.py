"""URL filtering: rules first, then trust and distrust carried over the link graph of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linedup import LOWER, UPPER
from .shared import write_table

#: Links in raw HTML: the quoted target of href, src or content.
LINK = r"""(?i)(?:href|src|content)\s*=\s*["']((?:https?:)?//[^"'\s<>]+)["']"""


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(name, allow); null where none does. The list is a configuration, of bounded length."""
    out = F.lit(None).cast("struct<name: string, allow: boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts, from the absolute links in the html; pre-aggregated before the shuffle."""
    return (
        pages.select(url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
        .select("src", url_host(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(hosts: DataFrame, links: DataFrame, *, damping: float, rounds: int, tolerance: float, at_once: int = 4) -> DataFrame:
    """(host, trust, distrust, rank): three personalised PageRanks in one pass per round.

    Trust starts from the trusted hosts and follows links; distrust starts from the blocked ones and follows links
    backwards, to those who link there; rank starts evenly. ``hosts`` has (host, trusted, blocked, pages). Rounds go on
    until the scores move by less than ``tolerance`` together, ``at_once`` of them in a job; if ``rounds`` do not suffice,
    it raises. Scores of a kind
    that has seeds add up to 1: what a host without links to follow holds goes back to the seeds.
    """
    kinds = {"trust": ("src", "dst"), "distrust": ("dst", "src"), "rank": ("src", "dst")}
    flows = None
    for kind, (a, b) in kinds.items():
        one = links.select(F.lit(kind).alias("kind"), F.col(a).alias("from"), F.col(b).alias("to"), "n")
        flows = one if flows is None else flows.unionByName(one)
    out = flows.groupBy("kind", "from").agg(F.sum("n").alias("sent"))
    flows = write_table(
        flows.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("sent")).alias("w")), "host-flows"
    )
    known = hosts.select("host", "trusted", "blocked").unionByName(
        links.select(F.col("dst").alias("host"), F.lit(False).alias("trusted"), F.lit(False).alias("blocked"))
    )
    known = known.groupBy("host").agg(F.bool_or("trusted").alias("trusted"), F.bool_or("blocked").alias("blocked"))
    start = known.select(
        "host",
        F.explode(
            F.create_map(
                F.lit("trust"), F.col("trusted").cast("double"), F.lit("distrust"), F.col("blocked").cast("double"), F.lit("rank"), F.lit(1.0)
            )
        ).alias("kind", "seed"),
    )
    mass = start.groupBy("kind").agg(F.sum("seed").alias("mass"))
    start = write_table(
        start.join(F.broadcast(mass), "kind").select("kind", "host", F.when(F.col("mass") > 0, F.col("seed") / F.col("mass")).otherwise(0.0).alias("seed")),
        "host-seeds",
    )
    def step(score: DataFrame) -> DataFrame:
        sent = score.join(flows.withColumnRenamed("from", "host"), ["kind", "host"])
        came = sent.groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("w")).alias("came"))
        now = ((1 - damping) * F.col("seed") + damping * F.coalesce("came", F.lit(0.0))).alias("score")
        return score.join(came, ["kind", "host"], "left").select("kind", "host", "seed", now, F.col("score").alias("was"))

    score, moved = start.withColumn("score", F.col("seed")), 0.0
    for done in range(0, 0 if flows.isEmpty() else rounds, at_once):
        for _ in range(min(at_once, rounds - done)):
            score = step(score)
        score = write_table(score, "host-scores")
        moved = score.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        if moved < tolerance:
            break
    if moved >= tolerance:
        raise RuntimeError(f"scores were still moving by {moved} after {rounds} rounds")
    # Sending what hosts without links hold back to the seeds makes all scores of a kind larger by one factor.
    total = F.broadcast(score.groupBy("kind").agg(F.sum("score").alias("total")))
    score = score.join(total, "kind").withColumn("score", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0))
    return score.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in kinds))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    damping: float = 0.85,
    rounds: int = 120,
    tolerance: float = 1e-6,
    threshold: float = 0.5,
    seed_share: float = 0.5,
) -> DataFrame:
    """Judge every page (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Where none fits, the page's host does: it is blocked if distrust makes up more
    than ``threshold`` of its distrust, trust and plain rank together. Seeds are the hosts of whose pages more than
    ``seed_share`` are allowed, or blocked, by rules. A null url, or one without ``://``, has an empty host, which
    has no links, and is allowed. Every row gets a verdict, repeated rows too.
    """
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    hosts = write_table(
        judged.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("hit.allow")).alias("allowed"),
            F.count_if(~F.col("hit.allow")).alias("barred"),
        )
        .select("host", "pages", (F.col("allowed") > seed_share * F.col("pages")).alias("trusted"), (F.col("barred") > seed_share * F.col("pages")).alias("blocked")),
        "hosts",
    )
    links = write_table(host_links(pages), "host-links")
    scores = propagate(hosts, links, damping=damping, rounds=rounds, tolerance=tolerance)
    total = F.col("trust") + F.col("distrust") + F.col("rank")
    verdicts = write_table(
        scores.select(F.col("host").alias("__host"), "trust", "distrust", (F.col("distrust") > threshold * total).alias("bad")), "host-verdicts"
    )
    return judged.join(verdicts, judged["host"] == verdicts["__host"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("hit.name").alias("rule"),
        F.when(F.coalesce(~F.col("hit.allow"), F.col("bad"), F.lit(False)), "block").otherwise("allow").alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
