"""cohortlens: outcome analytics on Spark DataFrames.

Every operator takes DataFrames (plus column names) and returns DataFrames.
The heavy lifting is expressed with the DataFrame API so Catalyst can prune,
push down and plan partial aggregation; nothing row-level is collected to the
driver.
"""

__version__ = "0.1.0"
