"""Machine-telemetry / OEE analytics on Spark.

Every metric is a DataFrame plan over a telemetry table of JSON readings
(``device_data``) plus small dimension tables.  Queries are fleet-wide by
default: per-device or per-company results are keyed columns, and optional
filters narrow them to one tenant or one machine.
"""

from shopfloor.params import Params

__all__ = ["Params"]
