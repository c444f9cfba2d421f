"""Process model: every business parameter of the analyses in one place.

The defaults reproduce the loan-application log the library was designed
around; any other log supplies its own :class:`ProcessModel`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original analysis for identical
# results: outcome classes, conformance model, SLA and wait bounds, labels.
# ---------------------------------------------------------------------------

# Outcome classes by last activity (anything else is "Unknown").
OUTCOME_APPROVED = ["A_Accepted", "A_Complete"]
OUTCOME_DENIED = ["A_Denied"]
OUTCOME_CANCELLED = ["O_Cancelled"]
OUTCOME_STILL_PROCESSING = [
    "W_Validate application", "W_Call after offers", "W_Call incomplete files",
    "W_Complete application", "W_Assess potential fraud",
    "W_Shortened completion", "W_Personal Loan collection",
]
OUTCOME_OFFER_SENT = ["O_Sent (mail and online)", "O_Sent (online only)", "O_Returned"]
OUTCOME_UNKNOWN = "Unknown"

# Conformance model.
CONFORMANCE_START = ["A_Create Application"]
CONFORMANCE_END = ["A_Complete", "A_Denied", "A_Cancelled"]
CONFORMANCE_REWORK_MARKERS = ["A_Pending", "O_Returned", "O_Cancelled"]
CONFORMANCE_A_PREFIX = "A_"
CONFORMANCE_O_PREFIX = "O_"
DEVIATION_NAMES = ["bad_start", "bad_end", "rework_detected", "wrong_order"]
NO_DEVIATION = "none"

# SLA and waiting-time bounds.
SLA_DAYS = 14
WAIT_MIN_HOURS = 0.0
WAIT_MAX_HOURS = 24.0 * 60  # exclusive: waits of 60 days or more are cut

# Duration buckets: (upper bound in days, inclusive) -> label; the last
# label also catches NULL durations.
DURATION_BUCKETS = [
    (7, "1 - 0-7 days (Fast)"),
    (14, "2 - 8-14 days (On Time)"),
    (21, "3 - 15-21 days (Late)"),
    (30, "4 - 22-30 days (Very Late)"),
]
DURATION_BUCKET_LAST = "5 - 30+ days (Critical)"

# Variant-rank buckets: (upper rank, inclusive) -> label, in display order.
RANK_BUCKETS = [
    (1, "Rank 1\n(Most common)"),
    (3, "Rank 2-3"),
    (10, "Rank 4-10"),
    (50, "Rank 11-50"),
]
RANK_BUCKET_LAST = "Rank 51+"

# Weekday codes for the models (Monday = 0 ... Sunday = 6).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                 "Saturday", "Sunday"]

# Text joining the activities of a variant, and the short-text rule.
VARIANT_SEPARATOR = " → "
VARIANT_SHORT_MAX = 80      # shorter texts are kept whole
VARIANT_SHORT_KEEP = 77     # longer ones keep this many chars + "..."

# Model-fitting parameters of the SLA-breach classifiers.
ML_SEED = 42
ML_TEST_FRACTION = 0.25
ML_FOLDS = 5
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 200, 6, 5
GB_ROUNDS, GB_DEPTH, GB_RATE = 100, 4, 0.1
LR_MAX_ITER = 500


def _outcome_map() -> dict[str, str]:
    m: dict[str, str] = {}
    for label, acts in [("Approved", OUTCOME_APPROVED), ("Denied", OUTCOME_DENIED),
                        ("Cancelled", OUTCOME_CANCELLED),
                        ("Still Processing", OUTCOME_STILL_PROCESSING),
                        ("Offer Sent", OUTCOME_OFFER_SENT)]:
        for a in acts:
            m.setdefault(a, label)
    return m


@dataclass(frozen=True)
class ProcessModel:
    """All parameters of the analyses.

    ``a_activities`` / ``o_activities`` replace the prefix test of the order
    rule by explicit sets when given.
    """

    outcome_map: dict = field(default_factory=_outcome_map)
    outcome_default: str = OUTCOME_UNKNOWN
    start_activities: tuple = tuple(CONFORMANCE_START)
    end_activities: tuple = tuple(CONFORMANCE_END)
    rework_markers: tuple = tuple(CONFORMANCE_REWORK_MARKERS)
    a_prefix: str = CONFORMANCE_A_PREFIX
    o_prefix: str = CONFORMANCE_O_PREFIX
    a_activities: tuple | None = None
    o_activities: tuple | None = None
    sla_days: int = SLA_DAYS
    wait_min_hours: float = WAIT_MIN_HOURS
    wait_max_hours: float = WAIT_MAX_HOURS
    completed_only: bool = False
    still_processing_label: str = "Still Processing"
    # Time slice (hours) used to split long/hot cases for sequence operators.
    slice_hours: int = 24
    # Exact (distributed rank) or sketch quantiles.
    exact_quantiles: bool = True

    def with_(self, **kw) -> "ProcessModel":
        return replace(self, **kw)


REFERENCE_MODEL = ProcessModel()

# Test choices for the driver's ``events`` table seen as a user-week log.
EVENTS_MODEL = ProcessModel(
    outcome_map={"purchase": "Approved", "error": "Denied", "click": "Cancelled",
                 "view": "Still Processing", "signup": "Offer Sent"},
    start_activities=("signup",),
    end_activities=("purchase",),
    rework_markers=("error",),
    a_activities=("view",),
    o_activities=("click",),
    sla_days=5,
)
