"""Words of running text as they compare."""

from __future__ import annotations

import html
import re
import unicodedata

from regesta.functions.text import MARKS

# Letters that do not decompose but are written out where they are missing.
_LIGATURES = str.maketrans({"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l"})
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrt]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_HYPHENATED = re.compile(r"(?<=\w)(?:­\s*|[-‐‑]\s*\n\s*)(?=\w)")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_WORD = re.compile(r"[a-z0-9]+")


def _unescape(m: re.Match[str]) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def _percent(m: re.Match[str]) -> str:
    try:
        return bytes.fromhex(m.group().replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def words(text: str) -> list[str]:
    """The words of a text in lower case, without accents, escapes, tags, hyphenation at line ends or punctuation."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _INVISIBLE.sub("", _HYPHENATED.sub("", text))
    return _WORD.findall(MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_LIGATURES))).lower())
