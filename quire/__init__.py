"""quire — document intelligence and vector retrieval as Spark jobs.

Sub-packages:
  functions  column expressions (vectors, text, time, JSON metadata)
  sources    scans: tables, page files, JSON records
  operators  search, predicates, vector table maintenance, actions, folders,
             text assembly, question answering, embedding, model apply
  plans      derived tables and the query catalogue used by the driver/bench
  streaming  Structured Streaming folds and continuous ingest
"""

__all__ = ["session"]
