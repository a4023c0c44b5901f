"""rowproof: a PySpark engine that turns read tables into judged tables."""
