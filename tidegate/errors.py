"""Driver-side exceptions. Row-level failures travel as ``STAGE_ERROR`` structs instead."""

from __future__ import annotations


class ScreenError(Exception):
    """Base of everything this package raises on purpose."""


class StageError(ScreenError):
    """A stage could not produce a result; keeps the stage name and the cause."""

    def __init__(self, stage: str, cause: Exception) -> None:
        super().__init__(f"stage {stage!r}: {type(cause).__name__}: {cause}")
        self.stage = stage
        self.cause = cause


class ResourceError(ScreenError):
    """A bank, profile or model could not be loaded; the cause is optional."""

    def __init__(self, resource: str, cause: Exception | None = None) -> None:
        detail = "" if cause is None else f": {type(cause).__name__}: {cause}"
        super().__init__(f"cannot load {resource}{detail}")
        self.resource = resource
        self.cause = cause
