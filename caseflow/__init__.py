"""caseflow — process-mining analytics on Spark DataFrames.

Every operator is a lazy ``DataFrame -> DataFrame`` function over an event log
with the canonical columns ``case_id, activity, ts, event_seq`` (see
:mod:`caseflow.schema`).  Nothing is collected to the driver except 1-row
scalars and size checks.
"""

from caseflow.model import ProcessModel, REFERENCE_MODEL
from caseflow.session import get_session, scratch_path

__all__ = ["ProcessModel", "REFERENCE_MODEL", "get_session", "scratch_path"]
