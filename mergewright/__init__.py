"""Spark-native record matching, ranking and training-data engine.

Layout: ``sources`` (scans and sinks), ``functions`` (scalar and text
functions), ``operators`` (relational, graph and sampling operators),
``plans`` (registered queries and their SQL twins), ``streaming`` and
``llm`` (optional, imported by nothing else in the library).
"""

__version__ = "0.1.0"
