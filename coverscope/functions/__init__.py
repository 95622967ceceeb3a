"""Scalar functions as Column builders; built-in functions but for the few that Spark lacks."""
