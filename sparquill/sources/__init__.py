"""Tables: where models are read from, and their versions."""

from .snapshots import Snapshots
from .tables import open_source

__all__ = ["Snapshots", "open_source"]
