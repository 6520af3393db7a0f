"""Jobs over catalog, page and notes tables. Every function takes and returns DataFrames."""
