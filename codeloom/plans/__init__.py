"""Registered queries; importing the package registers them all."""

from . import insights, registry, resolution

__all__ = ["insights", "registry", "resolution"]
