"""A PySpark engine for semi-structured price catalogues."""
