"""Whole dataflows, composed of operators."""
