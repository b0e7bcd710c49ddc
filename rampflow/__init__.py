"""rampflow: paired beat-series analytics as Spark plans."""
