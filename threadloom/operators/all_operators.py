"""Importing this registers every operator."""

from threadloom.operators import clusters, communities, features, fidelity, kernels, rules, statistics, temporal, text, trajectory, vectors, verdicts  # noqa: F401
from threadloom.sources import converters  # noqa: F401
from threadloom.streaming import queries  # noqa: F401
