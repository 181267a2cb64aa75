"""Security-event analytics on Spark: collect, parse, normalize, mask, check, hunt, retain."""

__version__ = "0.1.0"
