"""Speech and translation evaluation as Spark jobs.

Every public function takes DataFrames or Columns and gives back a DataFrame or
a Column.  Nothing here pulls rows to the driver: the plans are declared, Spark
runs them.
"""

__version__ = "0.1.0"
