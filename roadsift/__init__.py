"""Turns raw user feedback into a ranked, evidence-backed roadmap with Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing is collected or cached inside them, apart
from ``operators.themes.cluster``, which has to fit a model.
"""

__version__ = "0.1.0"
