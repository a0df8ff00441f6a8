"""The localization table and the settings of a drift run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A localization: its identity, position in nm, and the number of the frame it was seen in.
LOCS = T.StructType(
    [T.StructField("loc_id", T.LongType(), False), *(T.StructField(c, T.DoubleType(), False) for c in "xyz"), T.StructField("frame", T.IntegerType(), False)]
)
AXES = ("x", "y", "z")
DRIFT = ("dx", "dy", "dz")
#: The segmentation modes by number: windows of about equal counts, of a least count, of a number of frames.
BY_WINDOWS, BY_COUNT, BY_FRAMES = 0, 1, 2


@dataclass(frozen=True)
class DriftConfig:
    """Settings of ``estimate_drift``; the defaults are those of the programming interface, not of the command line."""

    segmentation_mode: int = BY_FRAMES
    segmentation_var: int = 10
    max_locs_per_segment: int | None = None
    initial_sigma_nm: float | None = None
    max_drift_nm: float = 300
    target_sigma_nm: float = 1
    boxcar_width: int = 1
    drift_max_bound_factor: float = 2
    interpolation_method: str = "cubic"
    min_max_frames: tuple[int, int] | None = None
    #: "median": median squared change, rounds go on past the target while it falls; "rms": the root mean square.
    criterion: str = "median"
    refine: bool = True
    seed: int = 0
    #: If given, more pairs than this (by estimate) are refused; none are ever left out, nor the radius made smaller.
    max_pairs: int | None = None
    #: "lbfgsb": bounded, limited memory. "bfgs": unbounded, whole inverse Hessian, 100 rounds at most. "projected": bounded.
    optimizer: str = "lbfgsb"
    #: After a failed minimisation: "retry" as it is, later at twice the width; "restart" from no drift at twice the width.
    on_failure: str = "retry"
    #: Pairs of so many bytes in all are evaluated on the driver, which saves a job each time; more on the executors.
    local_bytes: int = 8 << 20

    @property
    def sigma0(self) -> float:
        sigma = self.max_drift_nm // 3 if self.initial_sigma_nm is None else self.initial_sigma_nm
        if sigma <= 0:
            raise ValueError("the first sigma is 0: give initial_sigma_nm, or a max_drift_nm of 3 or more")
        return float(sigma)
