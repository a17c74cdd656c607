"""Analytic operators: DataFrame(s) and column names in, DataFrame out."""
