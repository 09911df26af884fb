"""shelfmark: catalogue text analytics and classification as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) plus column names and
returns a DataFrame (or Column); Spark plans and runs all of the work.
"""

__version__ = "0.1.0"
