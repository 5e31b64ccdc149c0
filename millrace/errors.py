"""The one exception that scripts and flows raise for their user's mistakes."""

from __future__ import annotations


class PipelineError(ValueError):
    def __init__(self, message: str, operator: str | None = None, line: int | None = None):
        where = ", ".join(x for x in (operator, f"line {line}" if line else None) if x)
        super().__init__(f"{where}: {message}" if where else message)
        self.operator, self.line = operator, line
