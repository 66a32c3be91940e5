"""mnesis: a PySpark-native analytics engine for episodic memory and training-data preparation."""

__version__ = "0.1.0"
