"""Where documents come from and go to: Parquet tables bound to models, and a versioned store of one's own."""

from .binding import Binding, bind
from .store import Manifest, Segment, Store

__all__ = ["Binding", "Manifest", "Segment", "Store", "bind"]
