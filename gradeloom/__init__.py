"""gradeloom: a Spark-native engine for colour-grading catalogs, similarity search, strip analytics and LUT algebra."""

__version__ = "0.1.0"
