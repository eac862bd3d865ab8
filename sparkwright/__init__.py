"""sparkwright: declarative ETL jobs and job-fleet analytics as Spark DataFrame plans.

* ``plans.run_job(spark, spec)`` runs a job described as data (tables, joins, predicates, transformations,
  target) as one lazy DataFrame plan.
* ``functions.jobs`` scores, classifies and sizes a whole table of job descriptors in one Spark job.
* ``operators`` holds the joins (including the broadcast and salted remedies), transformation routing,
  key-skew profiling and cached branches.
"""

from .plans.run import build_frame, run_job
from .session import build_session, shared_dir

__all__ = ["build_frame", "build_session", "run_job", "shared_dir"]

__version__ = "0.1.0"
