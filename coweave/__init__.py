"""coweave: co-occurrence graphs and tick streams on Spark.

Subpackages: ``functions`` (Column → Column), ``operators`` (DataFrame →
DataFrame, including the driver loops), ``sources`` (readers and writers),
``streaming`` (the Structured Streaming tick job) and ``plans`` (registered
queries with their DuckDB oracles).  ``session`` builds a session and cuts
loop lineage under ``spark.checkpoint.dir``.
"""
