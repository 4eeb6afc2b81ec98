"""scoria: a PySpark-native engine for outdoor-map data products."""

__version__ = "0.1.0"
