"""Progress hooks: what a plan is doing, told to a callback on the driver.

A hook gets ``(stage, current, total, tile)``.  Plans run over tables, so a stage is
told once per table and not per image; ``tile`` is text where one tile is meant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

#: Stage names (fixed values).
STAGES = ("idle", "query_features_start", "query_features_ready", "reference_features_start", "reference_features_ready", "match_features", "estimate_homography")

Progress = Callable[[str, int, int, "str | None"], None]


def told(progress: Progress | None, stage: str, current: int = 0, total: int = 0, tile: str | None = None) -> None:
    """Tell a stage; ValueError for a name that is none, nothing without a hook."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}: one of {', '.join(STAGES)}")
    if progress is not None:
        progress(stage, current, total, tile)


class BatchListener(StreamingQueryListener):
    """Tells ``idle`` with (rows of the batch, rows so far) whenever a micro-batch ends;
    for ``spark.streams.addListener``."""

    def __init__(self, progress: Progress) -> None:
        self.progress, self.rows = progress, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        told(self.progress, "idle", event.progress.numInputRows, self.rows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        told(self.progress, "idle", 0, self.rows)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
