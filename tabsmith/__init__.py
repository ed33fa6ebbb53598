"""tabsmith: profiling, cleaning, chart data, AutoML and query-log analytics as
Spark DataFrame jobs.

Every operator takes a DataFrame (plus plain parameters) and returns a tidy
DataFrame. Statistics that steer a later step (a mean used to fill, a z-score
bound) are reduced on the cluster to one bounded row and then applied as
literals, so the resulting plan stays a plain scan -> project/filter.
"""

__version__ = "0.1.0"
