"""hearth: listing analytics as Spark jobs.

Every operator is a function ``f(df, **params) -> DataFrame`` built from
Spark SQL functions and Spark ML. Nothing is collected to the driver except
scalar metadata (feature names, fitted-model summaries).
"""

__version__ = "0.1.0"
