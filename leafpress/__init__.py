"""leafpress: a PySpark engine for querying and transforming collections of structured documents."""
