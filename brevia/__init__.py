"""Short-text analytics on Spark: cleaning, profiling, encoding, training, evaluation."""

__version__ = "0.1.0"
