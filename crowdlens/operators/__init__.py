"""DataFrame operators. Column names and thresholds are arguments; results are lazy unless stated."""
