"""Point-in-time market analytics expressed as Spark DataFrame transformations.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing collects data to the
driver unless its docstring says which small, bounded value it needs.
"""
