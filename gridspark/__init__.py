"""Analytics on gridded time series and verification of forecasts, as Spark DataFrame operators.

Sub-packages
------------
functions   column expressions, feature recipes, class lookups
sources     scans, inventories, sinks and exports
operators   selections, joins, statistics, samples, verification, merging, scoring
plans       end-to-end jobs built from the operators
streaming   the same aggregates kept up to date from a stream
catalog     every operator run over the fixture tables, next to its SQL check
"""

PIXEL = ("y", "x")
