"""Refusals of requests."""

from __future__ import annotations


class RequestError(ValueError):
    """A request that is refused; ``status`` is its HTTP status."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status
