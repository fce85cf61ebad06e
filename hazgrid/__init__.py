"""Hazard, route-risk and transit analytics on PySpark."""
