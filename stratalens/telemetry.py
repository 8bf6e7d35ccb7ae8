"""Events with a level, a message and data, handed to registered handlers."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

LEVELS = ("debug", "info", "warning", "error")


@dataclass(frozen=True)
class Event:
    level: str
    msg: str
    data: dict = field(default_factory=dict)
    timestamp: float = field(default_factory=time.time)


def to_stderr(event: Event) -> None:
    print(f"{event.level.upper():7} {event.msg} {json.dumps(event.data, default=str) if event.data else ''}".rstrip(), file=sys.stderr)


_handlers: list[Callable[[Event], None]] = [to_stderr]


def add_handler(handler: Callable[[Event], None]) -> None:
    _handlers.append(handler)


def remove_handler(handler: Callable[[Event], None]) -> None:
    _handlers.remove(handler)


def emit(level: str, msg: str, **data) -> None:
    """Calls the handlers for events at or above STRATALENS_LOG (info)."""
    least = os.environ.get("STRATALENS_LOG", "info").lower()
    if LEVELS.index(level) >= LEVELS.index(least if least in LEVELS else "info"):
        event = Event(level, msg, data)
        for h in list(_handlers):
            h(event)


def debug(msg: str, **data) -> None:
    emit("debug", msg, **data)


def info(msg: str, **data) -> None:
    emit("info", msg, **data)


def warning(msg: str, **data) -> None:
    emit("warning", msg, **data)


def error(msg: str, **data) -> None:
    emit("error", msg, **data)
