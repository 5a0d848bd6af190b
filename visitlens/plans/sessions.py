"""Queries over visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.operators import sessions
from visitlens.plans.registry import STAMPED, VISITS, VOTES, register
from visitlens.sources.fixtures import Tables


@register("SELECT source, started_at, ended_at, n, max_confidence, rep_id FROM visits", *VISITS)
def a1_visits(t: Tables) -> DataFrame:
    return t.visits


@register("SELECT id, source, started_at FROM stamped", *STAMPED)
def a2_visit_members(t: Tables) -> DataFrame:
    return t.stamped.select("id", "source", "started_at")


@register(
    """SELECT v.source, v.started_at, v.ended_at, v.n, v.max_confidence, v.rep_id, s.species,
       row_number() OVER (ORDER BY v.source, v.started_at) AS visit_id
       FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at""",
    *VISITS, "votes", "visit_species",
)
def a3_rebuild_visits(t: Tables) -> DataFrame:
    """Numbers follow (source, started_at): the counts of each source's days, and of sources, are added up first, so no task orders all visits."""
    named = t.visits.join(sessions.winners(sessions.votes(t.stamped)).drop("margin"), ["source", "started_at"])
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.visits.groupBy("source").agg(F.count(F.lit(1)).alias("visits")).withColumn("offset", F.coalesce(F.sum("visits").over(before), F.lit(0)))
    earlier = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = named.groupBy("source", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("visits")).select("source", "day", F.coalesce(F.sum("visits").over(earlier), F.lit(0)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("source", "day").orderBy("started_at"))
    ranked = named.withColumn("day", F.to_date("started_at")).withColumn("rank", rank).join(days, ["source", "day"])
    return ranked.join(offsets, "source").withColumn("rank", F.col("rank") + F.col("held")).select(
        "source", "started_at", "ended_at", "n", "max_confidence", "rep_id", "species", (F.col("rank") + F.col("offset")).alias("visit_id")
    )


@register("SELECT id, source, started_at, species AS voted FROM (SELECT d.id, d.source, d.started_at, s.species FROM stamped d JOIN visit_species s USING (source, started_at))", *VOTES)
def l19_stamp_members(t: Tables) -> DataFrame:
    won = sessions.winners(sessions.votes(t.stamped)).select("source", "started_at", F.col("species").alias("voted"))
    return t.stamped.join(won, ["source", "started_at"]).select("id", "source", "started_at", "voted")


@register(
    """SELECT source, started_at, arg_min(species, (-n, first)) AS species,
       round((max(n) - coalesce(max(n) FILTER (rk = 2), 0)) / sum(n), 6) AS margin
       FROM (SELECT *, row_number() OVER (PARTITION BY source, started_at ORDER BY n DESC, first) AS rk FROM votes) GROUP BY source, started_at""",
    *STAMPED, "votes",
)
def a4_species_vote(t: Tables) -> DataFrame:
    return sessions.winners(sessions.votes(t.stamped)).select("source", "started_at", "species", F.round("margin", 6).alias("margin"))


GATED = """WITH gv AS (SELECT source, started_at, species, sum(confidence) AS weight, min((ts, id)) AS first FROM stamped WHERE confidence >= 0.8
    GROUP BY source, started_at, species),
  lv AS (SELECT source, started_at, species, sum(confidence) AS weight, min((ts, id)) AS first FROM stamped GROUP BY source, started_at, species),
  gr AS (SELECT *, row_number() OVER (PARTITION BY source, started_at ORDER BY weight DESC, first) AS rk FROM gv),
  lr AS (SELECT *, row_number() OVER (PARTITION BY source, started_at ORDER BY weight DESC, first) AS rk FROM lv),
  gs AS (SELECT source, started_at, max(species) FILTER (rk = 1) AS species,
         (max(weight) - coalesce(max(weight) FILTER (rk = 2), 0)) / sum(weight) AS margin FROM gr GROUP BY source, started_at),
  ls AS (SELECT source, started_at, max(species) FILTER (rk = 1) AS species,
         (max(weight) - coalesce(max(weight) FILTER (rk = 2), 0)) / sum(weight) AS margin FROM lr GROUP BY source, started_at),
  decided AS (SELECT ls.source, ls.started_at, coalesce(gs.species, ls.species) AS species, coalesce(gs.margin, ls.margin) AS margin,
         gs.species IS NOT NULL AS gated FROM ls LEFT JOIN gs ON ls.source = gs.source AND ls.started_at = gs.started_at)"""


@register(GATED + " SELECT source, started_at, species, round(margin, 6) AS margin, gated FROM decided", *STAMPED)
def a4_weighted_vote(t: Tables) -> DataFrame:
    return sessions.species_vote(t.stamped).withColumn("margin", F.round("margin", 6))


@register(
    GATED + """ SELECT count(*) AS visits, count(*) FILTER (d.species <> s.species) AS flips, count(*) FILTER (d.margin < 0.1) AS near_ties,
    count(*) FILTER (NOT gated) AS ungated FROM decided d JOIN visit_species s ON d.source = s.source AND d.started_at = s.started_at""",
    *VOTES,
)
def a5_vote_report(t: Tables) -> DataFrame:
    plain = sessions.winners(sessions.votes(t.stamped)).select("source", "started_at", F.col("species").alias("plain"))
    return sessions.species_vote(t.stamped).join(plain, ["source", "started_at"]).agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("species") != F.col("plain")).alias("flips"),
        F.count_if(F.col("margin") < 0.1).alias("near_ties"),
        F.count_if(~F.col("gated")).alias("ungated"),
    )


@register(
    """SELECT s.species, count(*) AS visits, CAST(sum(n) AS BIGINT) AS detections,
    list_sort(list(epoch_us(v.ended_at) - epoch_us(v.started_at)))[count(*) // 2 + 1] / 1e6 AS dwell_median,
    max(epoch_us(v.ended_at) - epoch_us(v.started_at)) / 1e6 AS dwell_max, count(*) FILTER (v.ended_at = v.started_at) AS flybys
    FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at GROUP BY s.species""",
    *VISITS, "votes", "visit_species",
)
def a6_visit_stats(t: Tables) -> DataFrame:
    return sessions.dwell_stats(t.visits.join(sessions.winners(sessions.votes(t.stamped)), ["source", "started_at"]))


@register(
    """WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY source ORDER BY ts, id) >= INTERVAL 6 HOUR AS brk FROM detections),
    b AS (SELECT source, max(ts) FILTER (brk IS NULL OR brk) AS last_start FROM g GROUP BY source)
    SELECT d.source, min(d.ts) AS started_at, max(d.ts) AS ended_at, count(*) AS n FROM detections d JOIN b ON d.source = b.source AND d.ts >= b.last_start GROUP BY d.source""",
    "detections",
)
def a38_live_visit(t: Tables) -> DataFrame:
    """The last run of each source, which a gap of exactly the limit ends."""
    runs = sessions.visits(t.detections, 6 * 3600, closed=True)
    return runs.groupBy("source").agg(F.max(F.struct("started_at", "ended_at", "n")).alias("x")).select("source", "x.*")


@register(
    """WITH o AS (SELECT *, (row_number() OVER (PARTITION BY source, started_at ORDER BY ts, id) - 1) // 24 AS part FROM stamped)
    SELECT source, started_at, part, count(*) AS n FROM o GROUP BY ALL""",
    *STAMPED,
)
def g20_bursts(t: Tables) -> DataFrame:
    return sessions.bursts(t.detections, 6 * 3600, 24)


@register(
    """WITH f AS (SELECT source, min(started_at) AS first FROM visits GROUP BY source)
    SELECT v.source, v.started_at, v.n FROM visits v JOIN f ON v.source = f.source AND v.started_at > f.first""",
    *VISITS,
)
def w16_visits_page(t: Tables) -> DataFrame:
    """Visits without the oldest of each source, which a page of rows may have cut."""
    v = t.visits
    return v.join(v.groupBy("source").agg(F.min("started_at").alias("first")), "source").where("started_at > first").select("source", "started_at", "n")
