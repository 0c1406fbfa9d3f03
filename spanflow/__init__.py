"""spanflow: Spark-native text/code probing operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or builds a
column expression).  Nothing is collected to the driver except tiny
metadata (grammar sizes, configuration lists, probe keys).
"""

__all__ = ["session", "operators", "sources", "functions", "plans", "streaming"]
