"""caseloom: case narratives and outcomes analysed on PySpark DataFrames."""
