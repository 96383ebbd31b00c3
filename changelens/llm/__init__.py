"""Operators of a training-data pipeline on Spark.

Each module holds one operator with a general interface; ``queries`` holds the
registered ``opN_*`` queries that apply them to whole tables.  Nothing outside
this subpackage (but ``corpus_pipeline.py`` and the entry module) imports it.
"""
