"""probatio: corpus-scale code verification and training-data analytics on Spark."""

__version__ = "0.1.0"
