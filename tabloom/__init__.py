"""Supervised learning on large tables, expressed as Spark jobs.

Quality profiling and gating, cleaning, exact reproducible splits, leak-safe
feature encoding, MLlib training, batch scoring, exact metrics and lift.
"""

from tabloom.spec import TableSpec, ValueRange

__all__ = ["TableSpec", "ValueRange"]
