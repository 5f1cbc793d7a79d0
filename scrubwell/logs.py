"""Log handlers: the console and a file, both with the same clock (nine hours ahead of UTC)."""

from __future__ import annotations

import logging
import time
from pathlib import Path

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"
AHEAD = 9 * 3600


def clock(seconds: float | None = None) -> time.struct_time:
    return time.gmtime((time.time() if seconds is None else seconds) + AHEAD)


def _dressed(handler: logging.Handler, level: int) -> logging.Handler:
    formatter = logging.Formatter(FORMAT)
    formatter.converter = clock
    handler.setFormatter(formatter)
    handler.setLevel(level)
    return handler


def stream_handler(level: int = logging.INFO) -> logging.Handler:
    return _dressed(logging.StreamHandler(), level)


def file_handler(path: str, level: int = logging.DEBUG) -> logging.Handler:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return _dressed(logging.FileHandler(path), level)


def logger(name: str = "scrubwell", path: str | None = None) -> logging.Logger:
    """A logger with a console handler and, with ``path``, a file handler; asking again adds none."""
    out = logging.getLogger(name)
    if not out.handlers:
        out.setLevel(logging.DEBUG)
        out.addHandler(stream_handler())
        if path:
            out.addHandler(file_handler(path))
    return out
