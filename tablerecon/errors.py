"""Errors raised by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ReconError(Exception):
    """Base class."""


class ValidationError(ReconError):
    """Violation rows were found.

    ``messages`` holds the first of them, ``violations`` the frame of all where a
    frame was checked.
    """

    def __init__(self, messages: list[str], more: bool = False, violations: DataFrame | None = None) -> None:
        self.messages = messages
        self.violations = violations
        tail = "\n- ..." if more else ""
        super().__init__("- " + "\n- ".join(messages) + tail)


class DuplicateKeyError(ReconError):
    """A key occurs more than once on one side of a reconciliation."""


class DependencyCycleError(ReconError):
    """Nodes remain that never become ready: the first in ``nodes``, all in ``frame``."""

    def __init__(self, nodes: list[str], more: bool = False, frame: DataFrame | None = None) -> None:
        self.nodes = nodes
        self.frame = frame
        super().__init__("dependency cycle among: " + ", ".join(nodes) + (", ..." if more else ""))


class StalePlanError(ReconError):
    """The snapshot moved on since the plan was made."""


class EmptyTableError(ReconError):
    """A table that must have rows has none."""
