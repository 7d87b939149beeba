"""Spark-native analytics for location questions and for training-data preparation.

Everything is a lazy DataFrame plan; Arrow functions appear only where no built-in
operator expresses the semantics (geometry, tokenising, automata).
"""

__version__ = "0.1.0"
