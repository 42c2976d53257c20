"""Power and temperature telemetry analytics on Spark DataFrames."""

from wattloom.series import Series

__all__ = ["Series"]
