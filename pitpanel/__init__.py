"""Point-in-time panel analytics as Spark DataFrame operators.

Conventions used by every operator
----------------------------------
* time columns are BIGINT epoch milliseconds (UTC); a bar is named by its open time and
  a decision at boundary ``t`` may use only bars that closed at or before ``t``;
* an undefined value is SQL NULL, never NaN;
* an operator takes DataFrames and column names and returns a lazy DataFrame. The only
  driver-side reads are ``take(1)`` probes in the guards that must raise.
"""

__version__ = "0.1.0"
