"""Run parameters of the workflow (one frozen object instead of module globals)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # fixed values of the original workflow (defaults of the production run)
    k_job: int = 500            # number of job (item) classes
    k_person: int = 1000        # number of person classes
    num_topics: int = 1000      # topic model size
    test_days: int = 60         # last days of the calendar used as test split
    gap_days: float = 7.0       # session gap, strictly greater starts a new session
    list_cnt: int = 30          # keep sessions with more than this many events
    top_k: int = 20             # held-out tail of a session / length of a ranked list
    cheby_order: int = 3        # Chebyshev order of the wavelet transform
    tolerance: float = 0.0      # wavelet entries below this are dropped
    scale: int = 1              # wavelet scale count
    val_prop: float = 0.2       # share of samples held out for evaluation
    seed: int = 1               # KMeans seed
    # derived / engine parameters
    bucket_seconds: int = 3600  # time bucket used to split hot keys in sessionization
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def gap_seconds(self) -> float:
        return self.gap_days * 86400.0


# Parameters used on the synthetic test tables (see FIXTURES.md): 100 item classes,
# 10 person classes, one-day gap, six test days.
TESTDATA_PARAMS = Params(k_job=100, k_person=10, test_days=6, gap_days=1.0,
                         list_cnt=30, top_k=20)
