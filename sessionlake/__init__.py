"""Session analytics on Spark: who was active in one sitting, and for how long."""

from sessionlake.plans.long_sessions import long_session_share, run_job
from sessionlake.session import spark_session

__all__ = ["long_session_share", "run_job", "spark_session"]
