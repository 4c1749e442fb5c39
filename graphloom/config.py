"""Settings in layers: defaults, a file, the command line, and what an analytic requires."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import ChainMap
from dataclasses import dataclass, field

#: Sections of the XML file; the third one is passed to the engine.
SECTIONS = ("system", "custom", "engine")


@dataclass
class Settings:
    """Three sections of text settings."""

    system: dict[str, str] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)
    engine: dict[str, str] = field(default_factory=dict)


def parse_xml(text: str) -> Settings:
    """Settings of a <configuration> with <system>, <custom> and <engine> (or <giraph>) sections of <property> elements
    with <name> and <value>; one that lacks either is an error."""
    out = Settings()
    try:
        top = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"malformed configuration: {e}") from e
    for tag, name in (("system", "system"), ("custom", "custom"), ("engine", "engine"), ("giraph", "engine")):
        for p in top.iterfind(f"{tag}/property"):
            key, value = p.findtext("name"), p.findtext("value")
            if key is None or value is None:
                raise ValueError("malformed configuration: a property needs a name and a value")
            getattr(out, name)[key] = value
    return out


def layered(*layers: Settings) -> Settings:
    """The layers as one; later ones win. In order: defaults, file, command line, required."""
    return Settings(*[dict(ChainMap(*[getattr(lv, s) for lv in reversed(layers)])) for s in SECTIONS])


def pairs(texts: list[str] | None) -> dict[str, str]:
    """``key=value`` texts as a dict; ``\\t`` in a value is a TAB and ``\\,`` a comma."""
    from graphloom.functions.delimiters import decode

    out = {}
    for t in texts or []:
        key, sep, value = t.partition("=")
        if not sep or not key:
            raise ValueError(f"not key=value: {t}")
        out[key] = decode(value) if value in ("\\t", "\\,") else value
    return out
