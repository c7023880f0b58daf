"""Importing this module registers every plan."""

from effectlab.plans import audits, effects, ingest, pictures, vectors  # noqa: F401
from effectlab.plans.registry import PLANS

__all__ = ["PLANS"]
