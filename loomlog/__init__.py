"""Spark-native analytics over semi-structured log records."""

from __future__ import annotations

__all__ = ["Engine", "build_session"]


def __getattr__(name: str):
    """Loaded when asked for, so that a worker that needs one module does not import all."""
    if name == "Engine":
        from .engine import Engine

        return Engine
    if name == "build_session":
        from .session import build_session

        return build_session
    raise AttributeError(name)
