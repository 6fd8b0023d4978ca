"""opslake: database-operations analytics on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from Spark SQL
expressions, so Catalyst prunes, pushes down and plans the shuffles.
"""

__version__ = "0.1.0"
