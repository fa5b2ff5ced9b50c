"""touchline: marketing attribution and campaign sizing on Spark.

Every operator is a plain DataFrame -> DataFrame (or Column -> Column)
function written with the Spark DataFrame/SQL API, so Catalyst and AQE
plan the physical work.  See README.md for the module map.
"""

__version__ = "0.1.0"
