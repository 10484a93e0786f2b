"""millrace: a Spark-first engine for event, sensor and corpus data.

One operator library, three ways in: DataFrame functions, a narrow SQL dialect
and JSON dataflow graphs.  Catalyst plans everything that is not a true fold.
"""

__version__ = "0.1.0"
