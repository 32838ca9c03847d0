"""lakeward: Spark-native warehouse metadata and table materialisation toolkit.

Every operator takes and returns Spark DataFrames and is built from
built-in Spark SQL / Structured Streaming primitives only.
"""

__version__ = "0.1.0"
