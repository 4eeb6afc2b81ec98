"""Texts folded to plain letters, and texts that say nothing."""

from __future__ import annotations

import unicodedata

# Texts that only say that a value is missing, by their letters and digits.
NO_NAME = frozenset(" na none null nil unknown noname nameunknown unnamed tbd nodata notavailable nan untitled missing".split(" "))


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.casefold()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))
