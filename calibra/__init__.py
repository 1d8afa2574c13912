"""calibra: decision scoring, calibration, gating and evaluation on Spark.

Every operator is a DataFrame -> DataFrame function (or a Column -> Column
expression) so that Catalyst sees one declarative plan per job. Probability
distributions travel as two parallel arrays in declared label order
(``labels ARRAY<STRING>``, ``probs ARRAY<DOUBLE>``).
"""

__version__ = "0.1.0"
