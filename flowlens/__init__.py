"""flowlens: labelled network-flow analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns a DataFrame;
nothing is collected to the driver beyond label dictionaries, quotas and
one-row metric records (all bounded by the number of classes).
"""

__version__ = "0.1.0"
