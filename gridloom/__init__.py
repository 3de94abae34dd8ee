"""gridloom: reductions of gridded data, archive catalogs and usage analytics on Spark.

Gridded data is a DataFrame with one row per cell: dataset_id, variable, realization, time,
level, lat, lon, value.  Every operator takes and returns DataFrames, so a chain of them is one
Spark plan.
"""
