"""yearloom: a PySpark engine for year-partitioned corpora and the panels made from them."""
