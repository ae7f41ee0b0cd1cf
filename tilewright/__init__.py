"""A Spark-first engine that prepares machine-learning training data.

Samples, annotations and texts are DataFrames; every operator is a function
from DataFrame to DataFrame (or from Column to Column).
"""

from tilewright.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
