"""relaylake: delivery-operations analytics expressed as Spark DataFrame jobs.

Tickets, run ledgers, stage runs, approvals, failure logs, source files,
endpoints and landed tables are processed as whole tables with Column
expressions, joins, aggregates and windows that Catalyst can optimise.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers may not have this package on their path (the driver
    imports it from the repository folder). Functions of this package used
    in pandas UDFs and stateful operators are therefore pickled by value."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark always ships it
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
