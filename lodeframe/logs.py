"""Logging to standard error, as text or JSON lines, with values bound to the context."""

from __future__ import annotations

import contextlib
import json
import logging
import sys
from contextvars import ContextVar
from datetime import datetime, timezone

from lodeframe.config import Logging

_bound: ContextVar[dict] = ContextVar("bound", default={})  # noqa: B039  never changed in place


@contextlib.contextmanager
def bound(**values):
    """Values that every record within carries."""
    token = _bound.set(_bound.get() | values)
    try:
        yield
    finally:
        _bound.reset(token)


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        found = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()} | _bound.get()
        if record.exc_info:
            found["error"] = self.formatException(record.exc_info)
        return json.dumps(found, default=str)


class Console(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        extra = "".join(f" {k}={v}" for k, v in _bound.get().items())
        text = f"{datetime.fromtimestamp(record.created):%H:%M:%S} {record.levelname:<7} {record.getMessage()}{extra}"
        return text + ("\n" + self.formatException(record.exc_info) if record.exc_info else "")


def configure(settings: Logging) -> logging.Logger:
    """The library's logger: to standard error, and to a file as JSON lines where one is named. May be called again."""
    logger = logging.getLogger("lodeframe")
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    handlers[0].setFormatter(JsonLines() if settings.format == "json" else Console())
    if settings.file:
        handlers.append(logging.FileHandler(settings.file, encoding="utf-8"))
        handlers[1].setFormatter(JsonLines())
    for h in handlers:
        logger.addHandler(h)
    logger.setLevel(settings.level.upper())
    logger.propagate = False
    return logger
