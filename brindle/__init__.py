"""DataFrame, array, text, metric and event-log analytics on PySpark."""
