"""Training-data operators: everything in this subpackage stands alone.

Nothing else in the library imports it; ``__spark_entry__.py`` adds its queries only when
it can be imported.
"""
