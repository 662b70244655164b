"""Compositions of operators: preprocessing, the end-to-end pipeline, the query catalog."""
