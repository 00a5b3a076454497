"""Plan E2: cleaned table -> summaries, spatial travel and playback tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.operators import animate, spatial, summarize
from telespark.operators.sessions import DEFAULT, SessionSpec


@dataclass
class Analysis:
    summary: DataFrame
    spawns: DataFrame
    segments: DataFrame
    travel: DataFrame
    playback: DataFrame
    spawn_points: DataFrame
    axis: DataFrame
    sample_rate: DataFrame


def analyse(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second",
            participant=None, condition=None) -> Analysis:
    """All analysis tables as lazy DataFrames.  ``participant``/``condition``
    restrict the playback to one session (row groups pruned on the cleaned
    Parquet layout); by default every session is played back."""
    sm = spatial.spawn_travel(prep, spec)
    play_in = prep
    if participant is not None:
        play_in = play_in.filter(F.col(spec.keys[0]) == participant)
    if condition is not None:
        play_in = play_in.filter(F.col(spec.keys[1]) == condition)
    return Analysis(
        summary=summarize.session_summary(prep, spec),
        spawns=sm,
        segments=spatial.segment_summary(sm),
        travel=spatial.travel_points(sm),
        playback=animate.densify(play_in, spec, unit=unit),
        spawn_points=animate.distinct_spawn_points(play_in, spec),
        axis=animate.axis_range(prep),
        sample_rate=summarize.sample_rate_points(prep, spec),
    )
