"""Parameters of the batch and the live plan, with their defaults (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.matching import AcceptConfig, MatcherConfig


@dataclass(frozen=True)
class LocalizeConfig:
    """Batch localization of a recording."""

    video_path: str = ""
    orthophoto_path: str = ""
    output_csv_path: str = ""
    matcher: MatcherConfig = MatcherConfig(backend="aliked", max_keypoints=2048, resize=1024)
    accept: AcceptConfig = AcceptConfig()
    frame_long_edge_px: int = 960
    video_start_seconds: float = 0.0
    frame_step_seconds: float = 1.0
    max_frames: int | None = None
    map_resize_width: int | None = 1600
    tile_sizes_px: tuple[int, ...] = (512, 768)
    tile_stride_ratio: float = 0.5
    local_search_radius_px: float = 420.0  # accepted and stored only
    relocalize_every_n_frames: int = 12
    telemetry_prior_tile_limit: int = 4
    track_local_tile_limit: int = 4
    eager_reference_features: bool = True


@dataclass(frozen=True)
class LiveConfig(LocalizeConfig):
    """The live plan: a shorter look at each frame, and the telemetry prior."""

    matcher: MatcherConfig = MatcherConfig(backend="sift", max_keypoints=1024, resize=768)
    accept: AcceptConfig = AcceptConfig(min_match_count=8, min_inlier_count=4, min_inlier_ratio=0.10)
    frame_step_seconds: float = 0.0
    tile_sizes_px: tuple[int, ...] = (512,)
    telemetry_prior_tile_limit: int = 3
    track_local_tile_limit: int = 3
    eager_reference_features: bool = False
    log_csv_root: str = ""
    utc_offset_hours: float = 3.0
    playback_delay_ms: int = 0
    map_crop_size_px: int = 720
    match_line_limit: int = 80
    no_display: bool = False
    first_match_timeout_sec: float = 60.0
