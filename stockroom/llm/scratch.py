"""Intermediate tables in the shared folder; see ``stockroom.sources.shared``."""

from __future__ import annotations

from stockroom.sources.shared import batches_of, folder, new_path, stored

__all__ = ["batches_of", "folder", "new_path", "stored"]
