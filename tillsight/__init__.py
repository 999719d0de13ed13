"""Retail customer analytics as PySpark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame``; lookup tables,
thresholds and the as-of time are arguments, so results never depend on the
wall clock.
"""
