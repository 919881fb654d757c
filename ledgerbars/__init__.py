"""ledgerbars: market-data and trade-audit analytics on PySpark."""

__version__ = "0.1.0"
