"""Declared schemas and the parameters of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Parameters of a study. Times are in microseconds unless their name says otherwise."""

    max_gap: int = 15 * SECOND  # longest step between frames that still counts as observed
    brightness: tuple[float, float] = (45.0, 235.0)
    sharpness: float = 20.0
    overlap: float = 0.35
    group_sharpness: tuple[tuple[str, float], ...] = (("C", 90.0),)
    holdouts: int = 30
    mae_limit: float = 1.0
    within_two: float = 0.95


#: Schemas as DDL, which every reader takes.
INVENTORY = (
    "frame_id string, group string, group_label string, sequence_index int, source_path string, relative_path string, size_bytes long, mtime_ns long, "
    "width int, height int, orientation int, timestamp timestamp_ntz, metadata_error string, interval_s double, elapsed_s double, timestamp_duplicate boolean"
)
DETECTION = (
    "detection_id: int, x: double, y: double, bbox: array<int>, side: string, zone: string, score: double, origin: string, suspect: boolean, accepted: boolean, "
    "area: int, peak: double, plant_distance: double, review_reasons: array<string>"
)
CANDIDATE = (
    "kind: string, x: double, y: double, bbox: array<int>, score: double, gray_q95: double, chroma_median: double, area: int, peak: double, elongation: double, extent: double, "
    "plant_distance: double, divided: boolean, whole_top: int"
)
CHECKPOINT = (
    "frame_id string, group string, source_path string, sequence_index int, sample_id string, processed_at string, status string, error string, sha256 string, "
    "source_unchanged boolean, quality_ok boolean, quality_reasons array<string>, scene_overlap double, brightness double, sharpness double, "
    "auto_left_count int, auto_right_count int, auto_other_count int, reflection_or_bottom_count int, suspect_count int, processing_seconds double, "
    f"detections array<struct<{DETECTION}>>, candidates array<struct<{DETECTION}>>"
)
REVIEW = "frame_id string, reviewer string, confirmed boolean, boxes array<struct<kind: string, bbox: array<double>>>, notes string, saved_at string"
FRAMES = "grp string, frame_id long, t long, left_count int, right_count int, valid boolean"
