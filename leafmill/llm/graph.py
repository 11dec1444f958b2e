"""Connected components, as the library's other jobs find them."""

from __future__ import annotations

from leafmill.plans.graph import components

__all__ = ["components"]
