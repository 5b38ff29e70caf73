"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from plumbline.plans import evaluation, experiments, lifecycle, manifests, shapes, storage  # noqa: F401  each registers its queries
from plumbline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
