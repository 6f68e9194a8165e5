"""dupescope: duplicate-report analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns); the heavy
work is planned by Catalyst and runs on the executors.
"""

__version__ = "0.1.0"
