"""Delimiters as command lines and configurations give them."""

from __future__ import annotations


def decode(text: str) -> str:
    """``\\x01``-style codes become their character, ``\\t`` a TAB; anything else is itself."""
    if text.startswith("\\x"):
        return chr(int(text[2:], 16))
    return {"\\t": "\t", "\\,": ","}.get(text, text)
