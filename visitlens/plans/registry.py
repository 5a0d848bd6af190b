"""Registration of queries, and the common table expressions that their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Each expression may use those before it.
CTES = {
    "detections": """SELECT event_id AS id, ts, user_id AS source, event_type AS species, value / 500 AS confidence,
        'k' || regexp_extract(props, '([0-9]+)', 1) AS individual, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value
        FROM events""",
    "flagged": """SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
        FROM detections WINDOW w AS (PARTITION BY source ORDER BY ts, id)""",
    "stamped": """SELECT *, max(CASE WHEN fresh = 1 THEN ts END) OVER (PARTITION BY source ORDER BY ts, id ROWS UNBOUNDED PRECEDING)
        AS started_at FROM flagged""",
    "visits": """SELECT source, started_at, max(ts) AS ended_at, count(*) AS n, max(confidence) AS max_confidence,
        arg_min(id, (-confidence, ts, id)) AS rep_id FROM stamped GROUP BY source, started_at""",
    "votes": """SELECT source, started_at, species, count(*) AS n, sum(confidence) AS weight, min((ts, id)) AS first
        FROM stamped GROUP BY source, started_at, species""",
    "visit_species": """SELECT source, started_at, arg_min(species, (-n, first)) AS species FROM votes GROUP BY source, started_at""",
    "clip_flagged": """SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh
        FROM detections WHERE species = 'view' WINDOW w AS (PARTITION BY source ORDER BY ts, id)""",
    "clip_stamped": """SELECT *, max(CASE WHEN fresh = 1 THEN ts END) OVER (PARTITION BY source ORDER BY ts, id ROWS UNBOUNDED PRECEDING)
        AS start_at FROM clip_flagged""",
    "clips": """SELECT source, start_at, max(ts) AS end_at, min(id) AS clip_id, count(*) AS detections, max(confidence) AS max_confidence
        FROM clip_stamped GROUP BY source, start_at""",
    "boxes": """SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS seq, l_quantity * 10 AS x1,
        l_extendedprice - 500 * floor(l_extendedprice / 500) AS y1,
        l_quantity * 10 + 40 + l_tax * 1000 AS x2, l_extendedprice - 500 * floor(l_extendedprice / 500) + 40 + l_discount * 1000 AS y2,
        (l_partkey % 100) / 100.0 AS score, l_returnflag AS species FROM lineitem""",
    "crops": """SELECT vec_id, CAST(label AS BIGINT) AS name, embedding, vec_id % 3 AS source, vec_id // 5 AS visit,
        (vec_id * 7919) % 1000 / 1000.0 AS quality, DATE '2024-01-01' + CAST(vec_id // 20 AS INTEGER) AS night FROM embeddings""",
}


def register(sql: str | None = None, *ctes: str, dates: tuple[str, ...] = ()):
    """Register a function of ``Tables`` under its name; ``sql`` may use the named table expressions.

    Columns in ``dates`` are returned as text, as readers differ in how they show dates.
    """

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in dates})
        if sql is not None:
            body = sql.strip()
            heads = [f"{c} AS ({CTES[c]})" for c in ctes]
            if body[:5].upper() == "WITH ":
                heads.append(body[5:])
                ORACLE_SQL[f.__name__] = "WITH " + ",\n".join(heads)
            else:
                ORACLE_SQL[f.__name__] = ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
            if dates:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
                ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({ORACLE_SQL[f.__name__]})"
        return f

    return add


DET = ("detections",)
STAMPED = ("detections", "flagged", "stamped")
VISITS = (*STAMPED, "visits")
VOTES = (*STAMPED, "votes", "visit_species")
CLIPS = ("detections", "clip_flagged", "clip_stamped", "clips")
