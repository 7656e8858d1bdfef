"""fabrel: declarative data generation, rule checking and table processing on PySpark."""
