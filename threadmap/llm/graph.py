"""Connected components of an edge table, as the core has them."""

from ..operators.graph import roots as components  # noqa: F401
