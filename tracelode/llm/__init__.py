"""Training-data operators. Nothing outside this subpackage imports it, but for the guarded hook in ``__spark_entry__``."""
