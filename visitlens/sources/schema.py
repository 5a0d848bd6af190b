"""Declared schemas of the domain tables; readers add what older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column lists of the domain tables, in DDL form.
DDL = {
    "detections": "id long, timestamp string, source string, detection_class string, confidence double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, frame_w int, frame_h int, crop_path string, frame_path string, species string, species_confidence double, species_verified int, species_source string, individual_id string, visit_id long, crop_quality double, labelled_at string, suppressed_at string, suppressed_by string, suppress_ref_id long, suppress_detail string, individual_source string, model_species string, model_species_confidence double, model_species_source string, labeled_by string",
    "visits": "id long, source string, species string, individual_id string, started_at string, ended_at string, detection_count long, max_confidence double, representative_detection_id long, species_margin double, sighting_conflict int",
    "clips": "id long, source string, clip_path string, started_at string, ended_at string, fps double, width int, height int, frame_count int, detection_count int, max_confidence double, pruned_at string, video_scanned_at string, video_detections int, video_max_conf double",
    "clip_tracks": "id long, clip_id long, model string, track_idx int, created_at string, n_samples int, n_hits int, track string, duration_s double, path_len double, net_disp double, straightness double, avg_speed double, peak_speed double, moving_frac double, area_trend double, stride_hz double, stride_strength double, walk_s double, individual_id string, individual_source string",
    "detection_embeddings": "id long, detection_id long, model string, dim int, embedding array<float>, created_at string",
    "live_sightings": "id long, source string, observed_at string, span_start string, span_end string, names string, stamped int, note string, superseded_at string, superseded_by long, labeled_by string",
    "coverage_events": "id long, source string, event string, at string, reason string",
    "individual_status": "name string, status string, effective_date string, note string, updated_at string, avatar_crop string, returned_on string",
    "view_epochs": "id long, source string, epoch long, started_at string, detected_by string, corr double",
    "ignore_zones": "id long, source string, x1 int, y1 int, x2 int, y2 int, note string, created_by string, created_at string, deleted_at string",
    "cameras": "id long, source string, name string, kind string, url_host string, url_path string, username string, password string, enabled int, deleted_at string",
}
#: Columns that no export carries.
PRIVATE = {"password", "username", "url_host", "url_path"}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in their order and types; null where the file lacks one; others are dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table under ``root``; an empty one where it is not there yet."""
    path = f"{root}/{table}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema(table))
    return conform(spark.read.option("mergeSchema", "true").parquet(path), table)
