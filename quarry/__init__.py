"""quarry — text-to-SQL corpus and query-log analytics as Spark DataFrame jobs.

Sub-packages:
  sources    readers for the example corpora, catalog and driver tables; sinks
  functions  shared column expressions and the fixed word/keyword lists
  operators  catalog profile, sampling, prompt assembly, value linking,
             query-log segmentation, scoring, structure/content slots
  plans      the registered query plans (relational constructs and the
             end-to-end jobs) with their DuckDB oracle texts
  streaming  incremental hypothesis intake (append sink) as Structured Streaming
"""

__all__ = ["session"]
