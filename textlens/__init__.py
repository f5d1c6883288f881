"""textlens: labelled short-text analytics as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
tuple of DataFrames) built from Column expressions, joins, aggregations and
windows so that Catalyst plans it and the work is spread over the cluster.
"""

__version__ = "0.1.0"
