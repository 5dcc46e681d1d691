"""depuse: artifact popularity from repository download logs, on Spark.

Every operator takes DataFrames and returns DataFrames.  The pipeline is

    text logs + dependency records            (sources)
      -> gav logs                             (operators.resolve)
      -> sessions                             (operators.sessions)
      -> dependency graph + closure           (operators.graph)
      -> per-session dependencies             (operators.deps)
      -> direct / indirect usage reports      (operators.report)

Composite jobs that read and write tables live in ``plans.jobs``.
"""

from depuse.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
