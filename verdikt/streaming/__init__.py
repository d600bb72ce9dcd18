"""Incremental runs over append-only inputs."""
