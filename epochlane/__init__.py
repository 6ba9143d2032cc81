"""Epoch-window analytics on Spark: keyed long tables in, keyed long tables out."""
