"""Values that define the semantics of alignment and ranking, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Bins a second, longest cue, onset pulse (seconds).
BINS = 100
MAX_CUE = 10.0
PULSE = 0.20
# Ratio of the second peak when there is none; coverage tolerance (seconds); fewest cues to align.
NO_SECOND_PEAK = 999.0
COVERAGE_TOLERANCE = 0.5
MIN_CUES_TO_ALIGN = 5
# Frame-rate ratios that are tried, unscaled first.
SCALES = (1.0, 1001 / 1000, 1000 / 1001, 25 / 24, 24 / 25, 25 / 23.976, 23.976 / 25)
# Piecewise penalties (seconds, share), radius (seconds), guard (bins).
SPLIT_PENALTY, SPLIT_LENGTH_PENALTY, SPLIT_RADIUS, SPLIT_GUARD = 6.0, 0.25, 30.0, 200
# Drift refinement.
DRIFT_FRACTION, DRIFT_DISAGREEMENT, DRIFT_MAX_DEVIATION, DRIFT_MIN_CUES, DRIFT_PASSES, DRIFT_MIN_SPAN = 0.35, 0.25, 0.05, 8, 4, 60.0
# Consensus on a shared bias of the reference.
BIAS_TOLERANCE, BIAS_MIN, BIAS_SHARE, BIAS_IGNORED = 0.15, 3, 0.75, 0.02
# Quality gates of a reference track.
MIN_REFERENCE_CUES, MAX_DUTY, MAX_CUES_PER_MINUTE, MAX_TRACKS = 10, 0.85, 90.0, 6
# Candidate files, lookups, history.
MIN_FILE_SIZE, MAX_LOOKUPS, MAX_ATTEMPTS, MAX_CONFIRMATIONS, MAX_OUTCOMES = 500, 4, 20, 10, 200


@dataclass(frozen=True)
class Settings:
    """What a user may change; the defaults are the usual ones."""

    max_search: float = 60.0
    peak_guard: float = 1.0
    scale_margin: float = 0.02
    min_correlation: float = 0.50
    min_onset_correlation: float = 0.25
    min_ratio: float = 1.20
    max_offset: float = 30.0
    min_correction: float = 0.15
    max_scale_deviation: float = 0.1
    framerate: bool = True
    allow_piecewise: bool = True
    decline_karaoke: bool = False
    max_blocks: int = 4
    min_block_cues: int = 10
    min_piecewise_coverage: float = 0.65
    min_coverage_gain: float = 0.10
    split_gain: float = 0.05
    max_candidates: int = 8
    allow_archives: bool = True
    retry_days: int = 14
    episodes_per_run: int = 250
    min_votes: int = 2
    source_tolerance: float = 0.05
    series_tolerance: float = 0.05
    #: Probable slips of the usual behaviour that can be put right by name.
    exact_has_full_coverage: bool = False
    bias_moves_exact: bool = True
    preference_can_win_back: bool = False


DEFAULTS = Settings()
VERDICTS = ("Unknown", "Exact", "ConstantOffset", "FramerateDrift", "PiecewiseCut", "Declined")
ACCEPTABLE = ("Exact", "ConstantOffset", "FramerateDrift", "PiecewiseCut")
