"""Intermediate tables in the folder that the whole cluster shares."""

from ..stash import discard, partitions, shared_dir, stash

__all__ = ["discard", "partitions", "shared_dir", "stash"]
