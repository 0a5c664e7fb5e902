"""Tessella: analytics operators for event, rating, feature and text data, as Spark DataFrame transformations."""
