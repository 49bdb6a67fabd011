"""cadenza: ordered-signal and event-list analytics on PySpark."""

__version__ = "0.1.0"
