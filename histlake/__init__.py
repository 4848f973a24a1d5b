"""histlake: a PySpark-native analytics engine for event and conversation history."""

__version__ = "0.1.0"
