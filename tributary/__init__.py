"""tributary: Spark-native analytics for reach time series, forecast cubes,
hydrography joins, table layouts and incremental file catalogs.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans
it and Spark runs it.  ``tributary.plans.registry`` binds the operators to
the named queries used by ``__spark_entry__.py`` and ``bench.py``.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers (pandas UDF
    bodies) are pickled by value, so executors need not have the package
    installed or on their path."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
