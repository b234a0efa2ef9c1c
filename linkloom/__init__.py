"""linkloom: story clustering, ranking and search over link sightings, on Spark."""

__version__ = "0.1.0"
