"""Characters that stand for bytes in byte-level vocabularies."""

from __future__ import annotations


def byte_characters() -> dict[str, int]:
    """Visible characters for themselves, the others from 256 on in order of their bytes."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
