"""Slices of a text by word numbers."""

from __future__ import annotations

import re
from collections.abc import Sequence

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: Sequence[tuple[int, int]], words: int) -> list[str]:
    """Texts of the word ranges ``[from, to)``; the range of all words is the
    text as it stands."""
    if all(span == (0, words) for span in spans):
        return [text] * len(spans)
    places = [m.span() for m in _WORD.finditer(text)]
    return [text if (f, t) == (0, words) else text[places[f][0]:places[t - 1][1]] for f, t in spans]
