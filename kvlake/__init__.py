"""Versioned key-value data on Spark: an ordered change log and the relational operators over it."""
