"""Training-data operators: thirteen corpus-scale Spark jobs.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it can be imported.
"""
