"""The library applied to the given tables, with SQL that states the same results."""
