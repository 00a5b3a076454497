"""telespark: session-telemetry analytics on Spark DataFrames.

Game logs (events, samples, session metadata) are loaded from delimited files,
merged, typed, cut into play periods and summarised per session, all as lazy
DataFrame plans.  Sub-packages:

* ``sources``   – log loading, driver tables, the telemetry adapter, sinks
* ``functions`` – column-level helpers (R-style null semantics, time, scalars)
* ``operators`` – DataFrame -> DataFrame operators (sessions, summaries,
                  spatial travel, playback tables, fits and mixed models)
* ``plans``     – end-to-end plans and the registry of named queries
* ``streaming`` – incremental ingest of newly arriving log files
"""

from telespark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
