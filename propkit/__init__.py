"""propkit: Spark-native property-analytics operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is built
from JVM-side Column / SQL expressions, Spark ML stages, or (only where no built-in
expression fits) Arrow-batched pandas UDFs.
"""

from propkit.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
