"""Walking parsed JSON of any depth, for the few operators that built-ins cannot express."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any


def parse(text: str | None) -> Any:
    """The parsed value, or None for anything that is not JSON."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def nodes(root: Any, note: Any, inherit: Callable[[Any, Any, Any], Any]) -> Iterator[tuple[Any, Any]]:
    """Every value below ``root`` in document order, each with a note.

    ``inherit(note, parent, key)`` gives the note of a child; the key of a list
    element is None.
    """
    waiting = [(root, note)]
    while waiting:
        value, note = waiting.pop()
        yield value, note
        pairs = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
        waiting.extend(reversed([(child, inherit(note, value, key)) for key, child in pairs]))
