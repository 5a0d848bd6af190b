"""Labels as append-only events: views of the latest value, differences, imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.operators.intervals import overlap_join
from visitlens.operators.order import numbered


def latest(events: DataFrame, keys: list[str], at: str, value: list[str], order: str | None = None) -> DataFrame:
    """The values of each key's newest event; ties go to the greatest ``order``. By aggregation, so a hot key is no sort."""
    rank = F.struct(at, *([order] if order else []))
    return events.groupBy(*keys).agg(F.max_by(F.struct(*value), rank).alias("x")).select(*keys, "x.*")


def apply_labels(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``rows`` (id, species) with the newest human ``species`` of ``events`` (id, at, species) and what the model had said."""
    newest = latest(events, ["id"], "at", ["species"]).select("id", F.col("species").alias("human"))
    return rows.join(newest, "id", "left").select(
        "id",
        F.coalesce("human", "species").alias("species"),
        F.when(F.col("human").isNotNull(), F.col("species")).alias("model_species"),
        F.when(F.col("human").isNotNull(), 1).otherwise(F.lit(None)).cast("long").alias("verified"),
    )


def renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``column`` after the renames of ``names`` (old, new), compared without case; a rename onto a name merges both."""
    mapping = names.select(F.lower("old").alias("__old"), F.col("new").alias("__new"))
    return rows.join(mapping, F.lower(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only in one of two tables, as sets, with ``change``."""
    return new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


def compare_metrics(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """(metric, was, now, verdict) of two tables (metric, value)."""
    both = old.select("metric", F.col("value").alias("was")).join(new.select("metric", F.col("value").alias("now")), "metric", "full")
    delta = F.col("now") - F.col("was")
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.abs(delta) <= tolerance, "same").when(delta > 0, "better").otherwise("worse")
    return both.withColumn("verdict", verdict)


def plan_import(batch: DataFrame, existing: DataFrame, *, content: Column, order: str) -> DataFrame:
    """NEW, DUPLICATE (same owner), CONFLICT (another owner) or UNREADABLE for each row of ``batch`` (owner, ...).

    Content is compared by SHA-256 with ``existing`` (sha, owner), then with the first row of the batch that holds it.
    """
    rows = batch.withColumn("sha", F.sha2(content, 256))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min_by(F.struct(F.col("owner").alias("o"), F.col(order).alias("k")), order).alias("head"))
    held = existing.groupBy("sha").agg(F.min("owner").alias("held"))
    joined = rows.join(first, "sha", "left").join(held, "sha", "left")
    other = F.coalesce("held", F.when(F.col("head.k") != F.col(order), F.col("head.o")))
    state = F.when(F.col("sha").isNull(), "UNREADABLE").when(other.isNull(), "NEW").when(other == F.col("owner"), "DUPLICATE").otherwise("CONFLICT")
    return joined.select(*batch.columns, state.alias("state"))


def epochs(bumps: DataFrame) -> DataFrame:
    """(source, epoch, started_at, ended_at): each bump opens a view that lasts to the next."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy("at")
    return bumps.select("source", F.row_number().over(w).cast("long").alias("epoch"), F.col("at").alias("started_at"), F.lead("at").over(w).alias("ended_at"))


def remove(rows: DataFrame, doomed: DataFrame, keys: list[str], manifest: str | None = None) -> DataFrame:
    """``rows`` without those of ``doomed``; what goes is first appended to ``manifest``."""
    if manifest is not None:
        rows.join(doomed.select(*keys).distinct(), keys, "left_semi").write.mode("append").parquet(manifest)
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def at_shares(rows: DataFrame, shares: list[float], *by: str) -> DataFrame:
    """The rows at these shares of the way through the order of ``by``, with their ``position``; each row once."""
    placed = numbered(rows, *by)
    n = placed.count()
    wanted = sorted({round(s * (n - 1)) for s in shares}) if n else []
    return placed.where(F.col("position").isin(wanted))


def with_reference(rows: DataFrame, references: DataFrame) -> DataFrame:
    """``rows`` with what ``references`` (ref_id and more) says of the one they name; nulls where there is none. References
    are retired but never deleted, so old rows find theirs."""
    return rows.join(references, "ref_id", "left")


def apply_visit_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` after what people said of whole visits.

    ``rows``: id, visit, species, species_confidence, species_source, verified, individual, individual_source, labelled_at, labeled_by,
    model_species; ``labels``, one a visit: visit, species (corrects every row, and keeps what the model had said), verify (confirms what
    is there, where no species is given), sets_name and name (null clears), at, by. A name goes to the rows of the visit's commonest
    species after the correction (of equal ones the first by name), to all rows where none has a species; the others keep theirs.
    """
    joined = rows.join(labels.select("visit", F.col("species").alias("__species"), "verify", "sets_name", F.col("name").alias("__name"), "at", "by"), "visit", "left")
    given = F.col("__species").isNotNull() & (F.col("__species") != "")
    fixed = joined.withColumn("model_species", F.when(given, F.coalesce("model_species", "species")).otherwise(F.col("model_species")))
    fixed = fixed.withColumn("species", F.when(given, F.col("__species")).otherwise(F.col("species")))
    fixed = fixed.withColumn("species_confidence", F.when(given, 1.0).otherwise(F.col("species_confidence"))).withColumn("species_source", F.when(given, "human").otherwise(F.col("species_source")))
    fixed = fixed.withColumn("verified", F.when(given | F.coalesce("verify", F.lit(False)), 1).otherwise(F.col("verified")))
    counts = fixed.where("sets_name and species is not null").groupBy("visit", F.col("species").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("visit").agg(F.min_by("s", F.struct((-F.col("n")).alias("less"), "s")).alias("__main"))
    named = fixed.join(main, "visit", "left")
    hit = F.coalesce("sets_name", F.lit(False)) & (F.col("__main").isNull() | F.coalesce(F.col("species") == F.col("__main"), F.lit(False)))
    put = lambda c, value: F.when(hit, value).otherwise(F.col(c)).alias(c)
    values = {"individual": F.col("__name"), "individual_source": F.when(F.col("__name").isNotNull(), "human"), "labelled_at": F.col("at"), "labeled_by": F.col("by")}
    return named.select(*(put(c, values[c]) if c in values else F.col(c) for c in rows.columns))


def labels_of_spans(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, label) of the rows that lie in labelled spans of time: ``spans``: source, a0, a1, label; ``rows``: source, id, ts. Both ends count."""
    points = rows.select("source", "id", F.col("ts").alias("b0"), F.col("ts").alias("b1"))
    return overlap_join(spans, points).select("id", "label")


def video_hashes(references: DataFrame) -> DataFrame:
    """(sha, individual, frames): videos that were scanned before, with the first name and how many frames are certified; none without a hash."""
    known = references.where("sha is not null").groupBy("sha")
    return known.agg(F.min("individual").alias("individual"), F.count(F.lit(1)).alias("frames"))


def set_tracks(tracks: DataFrame, names: DataFrame) -> DataFrame:
    """``tracks`` (track, individual, individual_source) with the names that people gave (``names``: track, name; null clears), marked as theirs."""
    given = tracks.join(names.withColumn("__told", F.lit(True)), "track", "left")
    told = F.coalesce("__told", F.lit(False))
    return given.withColumn("individual", F.when(told, F.col("name")).otherwise(F.col("individual"))).withColumn(
        "individual_source", F.when(told, F.when(F.col("name").isNotNull(), "human")).otherwise(F.col("individual_source"))
    ).drop("name", "__told")


def stamped(rows: DataFrame, events: DataFrame, keys: list[str], at: str, value: list[str]) -> DataFrame:
    """``rows`` with the values and the time of each key's newest event; nulls where there was none."""
    newest = events.groupBy(*keys).agg(F.max_by(F.struct(at, *value), at).alias("x")).select(*keys, "x.*")
    return rows.join(newest, keys, "left")


def valid_references(rows: DataFrame, *, lights: list[str]) -> tuple[DataFrame, DataFrame]:
    """(saved, refused) of reference pictures: the light must be one of ``lights`` (without regard to case and blanks), as a typo would
    never be found again, and source and provenance must be told."""
    light = F.lower(F.trim(F.coalesce("illumination", F.lit(""))))
    told = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    good = light.isin(lights) & told("source") & told("provenance")
    return rows.where(good).withColumn("illumination", light), rows.where(~good)


def newest(events: DataFrame, n: int, *, at: str, order: str, where: Column | None = None) -> DataFrame:
    """The newest ``n`` of ``events`` (of those for which ``where`` holds); a task hands on its own newest only. The page is the feature."""
    rows = events if where is None else events.where(where)
    return rows.orderBy(F.desc(at), F.desc(order)).limit(n)


def live(rows: DataFrame, *, also: Column | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Rows without a tombstone (``deleted_at``), without columns that nobody may see."""
    kept = rows.where(F.col("deleted_at").isNull() if also is None else F.col("deleted_at").isNull() & also)
    return kept.drop(*hidden)


def bury(rows: DataFrame, ids: DataFrame, at: Column | str) -> DataFrame:
    """``rows`` with a tombstone on those of ``ids`` (id) that have none yet; nothing is deleted, and an earlier tombstone stays."""
    marked = rows.join(ids.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    when = F.col(at) if isinstance(at, str) else at
    return marked.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("__gone"), when))).drop("__gone")


def set_names(rows: DataFrame, given: DataFrame) -> DataFrame:
    """``rows`` (id, individual, individual_source, labelled_at) with what people said of single ones (``given``: id, name, at); null
    clears the name and who gave it, and keeps when."""
    told = rows.join(given.select("id", "name", F.col("at").alias("__at"), F.lit(True).alias("__told")), "id", "left")
    hit = F.coalesce("__told", F.lit(False))
    named = told.withColumn("individual", F.when(hit, F.col("name")).otherwise(F.col("individual")))
    named = named.withColumn("individual_source", F.when(hit, F.when(F.col("name").isNotNull(), "human")).otherwise(F.col("individual_source")))
    return named.withColumn("labelled_at", F.when(hit, F.col("__at")).otherwise(F.col("labelled_at"))).drop("name", "__at", "__told")


#: The columns that say by what a row is suppressed.
SUPPRESSION = ["suppressed_at", "suppressed_by", "suppress_ref_id", "suppress_detail"]


def clear_suppression(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with all columns of the suppression empty on those of ``ids`` (id)."""
    freed = rows.join(ids.select("id").distinct().withColumn("__free", F.lit(True)), "id", "left")
    return freed.withColumns({c: F.when(F.col("__free").isNull(), F.col(c)) for c in SUPPRESSION}).drop("__free")


def suppressed(rows: DataFrame, *, by: str, now: Column, days: float = 7, detail: str = "decision string, reason string") -> DataFrame:
    """What the mechanism ``by`` suppressed in the last ``days``, with its decision read from ``suppress_detail`` (null where it can't be)."""
    recent = F.timestamp_diff("MICROSECOND", F.col("suppressed_at"), now) <= int(days * 86400e6)
    return rows.where((F.col("suppressed_by") == by) & recent).withColumn("decision", F.from_json("suppress_detail", detail))


#: The prefix of sources that only hold reference pictures.
REFERENCE = "ref:"


def is_reference_source(source: Column | str) -> Column:
    return F.coalesce(F.startswith(F.col(source) if isinstance(source, str) else source, F.lit(REFERENCE)), F.lit(False))


def orphans(frames: DataFrame, rows: DataFrame, *, on: str = "frame_path") -> DataFrame:
    """Written frames that no row refers to any more; a frame is safe as long as one row of any source has it."""
    return frames.join(rows.where(F.col(on).isNotNull()).select(on).distinct(), on, "left_anti")
