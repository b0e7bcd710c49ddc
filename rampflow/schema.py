"""Names, windows and settings of the beat-series engine."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CELL = ["subject", "phase"]
PHASES = ("Pre", "Stim", "Post")
DIRECTIONS = ("up", "down")
CONTRASTS = (("Stim", "Pre"), ("Post", "Pre"), ("Post", "Stim"))

# Half-open windows in seconds, and names of the public beat table's columns.
WINDOWS = {
    "phase": (("Pre", 0.0, 300.0), ("Stim", 300.0, 600.0), ("Post", 600.0, 900.0)),
    "subphase": (("Pre_early", 0.0, 150.0), ("Pre_late", 150.0, 300.0), ("Stim_early", 300.0, 450.0), ("Stim_late", 450.0, 600.0), ("Post_early", 600.0, 750.0), ("Post_late", 750.0, 900.0)),
}
BEAT_HEADER = ("beat_idx", "RRI_ms", "SBP_mmHg", "PAT_ms")
PAIRED_HEADER = ("R_wave_timing_ms", "RRI_ms", "sBP_timing_ms", "sBP_mmHg100", "PAT_ms")

BEATS = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("beat_idx", T.IntegerType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("rri", T.DoubleType()),
        T.StructField("sbp", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Setting:
    """One way to estimate a sequence gain."""

    name: str
    lag: int = 1
    least_step: float = 1.0
    strict_step: bool = False
    least_beats: int = 3
    overlap: bool = False
    least_r: float | None = 0.80
    least_r2: float | None = None  # strict
    positive_slope: bool = False
    rri_direction: bool = False
    least_rri_step: float | None = None  # strict
    median: bool = False

    @property
    def setting_id(self) -> str:
        def tag(x: float, digits: int) -> str:
            return f"{x:.{digits}f}".replace(".", "p")

        core = f"lag{self.lag}_r{tag(self.least_r or 0.0, 2)}_sbp{tag(self.least_step, 1)}_len{self.least_beats}_{'median' if self.median else 'mean'}"
        return core + "_directional_rri_gate" * self.rri_direction


# Fixed values, to the end of the sub-phase contrasts: the published settings, branches and contrasts.
CANONICAL = Setting("canonical")
OFAT = (
    CANONICAL,
    replace(CANONICAL, name="lag_0", lag=0),
    replace(CANONICAL, name="lag_2", lag=2),
    replace(CANONICAL, name="correlation_0.70", least_r=0.70),
    replace(CANONICAL, name="correlation_0.85", least_r=0.85),
    replace(CANONICAL, name="sbp_increment_0.5", least_step=0.5),
    replace(CANONICAL, name="minimum_length_4", least_beats=4),
    replace(CANONICAL, name="aggregation_median", median=True),
)
FACTORIAL = tuple(
    (s := Setting("", lag, step, False, beats, False, r, median=median)) and replace(s, name=s.setting_id)
    for lag, r, step, beats, median in product((0, 1, 2), (0.70, 0.80, 0.85), (0.5, 1.0), (3, 4), (False, True))
)
_TEXT = Setting("", strict_step=True, least_r=None, least_r2=0.85, positive_slope=True, rri_direction=True, least_rri_step=1.0)
BRANCHES = (
    replace(CANONICAL, name="REF"),
    replace(_TEXT, name="A0_MAX", lag=0),
    replace(_TEXT, name="A1_MAX", lag=1),
    replace(_TEXT, name="A0_OVERLAP", lag=0, overlap=True),
    replace(_TEXT, name="A1_OVERLAP", lag=1, overlap=True),
)

SUBPHASE_CONTRASTS = (
    ("Pre_late", "Pre_early"),
    ("Stim_early", "Pre_late"),
    ("Stim_late", "Stim_early"),
    ("Stim_late", "Pre_late"),
    ("Post_early", "Stim_late"),
    ("Post_late", "Post_early"),
)


@dataclass(frozen=True)
class Neighbours:
    """One way to run the neighbour estimators; no length is the whole phase."""

    name: str
    length: int | None = 256
    k: int = 30
    depth: int = 8
    source_now: bool = False


# The primary setting and seven that differ from it in one factor.
NEIGHBOURS = (
    Neighbours("primary"),
    Neighbours("k20", k=20),
    Neighbours("k40", k=40),
    Neighbours("lag4", depth=4),
    Neighbours("lag12", depth=12),
    Neighbours("same_beat_convention", source_now=True),
    Neighbours("centered192", length=192),
    Neighbours("full_phase", length=None),
)

SETTING_SCHEMA = (
    "setting string, ordinal int, lag int, least_step double, strict_step boolean, least_beats int, overlap boolean, least_r double, "
    "least_r2 double, positive_slope boolean, rri_direction boolean, least_rri_step double, use_median boolean"
)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of names, numbers and flags as literals of the plan: no Python worker makes them."""
    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else repr(x) + "D" * isinstance(x, float)

    fields = [f.strip().split() for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    names = ", ".join(f"`{n}`" for n, _ in fields)
    return spark.sql(f"SELECT {', '.join(f'CAST(`{n}` AS {kind}) AS `{n}`' for n, kind in fields)} FROM VALUES {values} AS v({names})")


def settings_frame(spark: SparkSession, settings: tuple[Setting, ...]) -> DataFrame:
    rows = [
        (s.name, i, s.lag, float(s.least_step), s.strict_step, s.least_beats, s.overlap, s.least_r, s.least_r2, s.positive_slope, s.rri_direction, s.least_rri_step, s.median)
        for i, s in enumerate(settings)
    ]
    return literal_frame(spark, rows, SETTING_SCHEMA)


def windows_frame(spark: SparkSession, kind: str) -> DataFrame:
    return literal_frame(spark, [(n, lo, hi, i) for i, (n, lo, hi) in enumerate(WINDOWS[kind])], "window string, lo double, hi double, ord int")
