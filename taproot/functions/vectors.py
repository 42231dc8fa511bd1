"""Column functions on points and vectors, for use in plain selects."""

from taproot.operators.spatial import angle, distance, squared

__all__ = ["angle", "distance", "squared"]
