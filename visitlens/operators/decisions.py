"""Whether a detection may be suppressed, in a fixed order of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def veto(boxes: DataFrame, references: DataFrame, thresholds: DataFrame, *, corr_min: float, max_age_s: float, cover_min: float, min_events: int, min_days: int) -> DataFrame:
    """``boxes`` with decision (abstain, keep, suppress) and the first reason that holds.

    ``boxes``: source, epoch, at_s, illumination, corr (of the views), cover (the reference's share of the box), scores (a map of
    metric to difference), events and days (how often the place recurred); ``references``: source, ref_id, ref_epoch, ref_at_s, at most
    one a source; ``thresholds``: illumination, limits (a map of metric to limit). A box is suppressed only if its reference holds good and every
    metric with a limit lies below it and its place recurred; a score that is missing keeps it.
    """
    rows = boxes.join(references, "source", "left").join(F.broadcast(thresholds), "illumination", "left")  # a row an illumination
    age = F.round(F.col("at_s") - F.col("ref_at_s"), 1)
    reasons: list[tuple[Column, str, str]] = [
        (F.col("ref_id").isNull(), "abstain", "no_reference"),
        (~F.col("ref_epoch").eqNullSafe(F.col("epoch")), "abstain", "view_epoch_changed"),
        (~F.coalesce(F.round("corr", 3) >= corr_min, F.lit(False)), "abstain", "camera_moved"),
        (~F.coalesce((age <= max_age_s) & (age >= 0), F.lit(False)), "abstain", "reference_stale"),
        (~F.coalesce(F.round("cover", 4) >= cover_min, F.lit(False)), "abstain", "reference_has_no_pixels_here"),
        (F.coalesce(F.size("limits"), F.lit(0)) <= 0, "abstain", "no_thresholds_for_illumination"),
        (~F.forall(F.map_entries("limits"), lambda m: F.coalesce(F.try_element_at("scores", m["key"]) < m["value"], F.lit(False))), "keep", "pixels_differ_from_empty"),
        (~F.coalesce((F.col("events") >= min_events) & (F.col("days") >= min_days), F.lit(False)), "keep", "not_recurrent_enough"),
        (F.lit(True), "suppress", "matches_empty_reference_at_a_recurring_spot"),
    ]
    chain = lambda at: F.coalesce(*(F.when(test, verdict[at]) for test, *verdict in ((t, d, r) for t, d, r in reasons)))
    return rows.withColumn("decision", chain(0)).withColumn("reason", chain(1))


def video_scope(frames: DataFrame) -> DataFrame:
    """(video, scope): group if any scanned frame of the video showed two animals at once, else individual. ``frames``: video, n_animals."""
    several = F.bool_or(F.coalesce(F.col("n_animals") >= 2, F.lit(False)))
    return frames.groupBy("video").agg(F.when(several, "group").otherwise("individual").alias("scope"))
