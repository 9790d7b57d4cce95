"""Spans of a text as (kind number, start, end) in code points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[int, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], s[0], s[2])))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def masked(text: str, spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its
    first one, like [EMAIL]."""
    out, done, end = [], 0, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out += [text[done if done > end else end : a], f"[{kinds[k].upper()}]"]
        end = max(end, b)
        done = end
    return "".join([*out, text[end:]])
