"""quern: a relational analytics engine on PySpark DataFrames."""
