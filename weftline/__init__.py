"""weftline: duplicate search and record shaping on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame.  Plans are declared
with built-in expressions wherever those can state the semantics; the few
operators that need per-value imperative work run in Arrow batches.
"""

__version__ = "0.1.0"
