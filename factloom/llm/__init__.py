"""Training-data operators. Nothing outside this subpackage imports it, except the guarded hook in ``__spark_entry__``."""
