"""Operators for preparing language-model training data. Nothing else in the library imports
this package; `__spark_entry__.py` adds its queries when it is present."""
