"""tessera — result-set analytics expressed as Spark DataFrame jobs.

Sub-packages:
  sources    reading tables and run files, writing them back safely
  functions  Column -> Column helpers (text cleaning, value normalisation, keywords)
  operators  DataFrame -> DataFrame operators, one module per family
  plans      shared physical-plan helpers (bounded broadcast, skew-safe ordering)
             and the derived substrates built from the driver's test tables
  streaming  Structured Streaming twins of the incremental batch operators
"""

__version__ = "0.1.0"
