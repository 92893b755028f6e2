"""postlens: mining community posts with Spark DataFrames."""

__version__ = "0.1.0"
