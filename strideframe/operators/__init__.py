"""Operators on trajectory tables: DataFrame in, DataFrame out. Series are keyed by columns given as a list and ordered by frame."""
