"""weekcell: sparse place-and-time event rates on Spark.

Every public function takes and returns DataFrames (or Columns); Catalyst
plans the work. See README.md for the map from operator IDs to modules.
"""
