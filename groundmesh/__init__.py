"""Spark operators for observation networks, deformation zones and their time series."""
