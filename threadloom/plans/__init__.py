"""Canonical tables derived from the driver's inputs."""
