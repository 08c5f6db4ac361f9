"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, but for the guarded import in __spark_entry__.py."""
