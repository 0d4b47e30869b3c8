"""Shared storage for intermediate tables: the library's own."""

from loomstead.storage import discard, durable, new_path, shared_dir

__all__ = ["discard", "durable", "new_path", "shared_dir"]
