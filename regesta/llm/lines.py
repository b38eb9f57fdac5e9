"""Lines of page text: their shape and their template, which stand in for the tags and classes of markup.

Nothing here knows a phrase of any language: what a line is by its words is learnt from the pages (see mainbody).
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SEPARATOR = re.compile(r"\s+[|·•›»>/–—]\s+|\s*[|·•›»]\s*|\s{2,}|\t+")
_CRUMB = re.compile(r"\s*(?:»|>|/|›|::)\s+")
_LEAD = re.compile(r"^(.*?\S)(?:\s*[:.!?|·•›»>]|\s+[/–—]|\s{2,}|\t)\s*\S")
_NUMBER = re.compile(r"\d+")
_NAME = re.compile(r"(?<=[\s’'(-])[A-ZÀ-ÖØ-Þ][\w’'-]*")
_CONTACT = re.compile(r"@|\[\s*at\s*\]|(\+33|\b0)[\s.(\-]*\d([\s.)\-]*\d){7,}|\b00 ?33\d{9}", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…:;]\s*[»)]?$")
_ITEM = re.compile(r"^[-*•–·]\s+\S|^\d+[.)]\s+\S")
#: A mark of omission with words after it that do not go on with the sentence: the label of a link.
_CLIPPED = re.compile(r"(?:…|\.\.\.)\s*[\[(]?[^\W\d_][^.!?…]*$")

#: Shapes of lines with text of their own.
TEXT = frozenset({"prose", "item", "contact", "table"})


class Line(NamedTuple):
    number: int  # from 1, over all lines split at LF
    shape: str
    frame: int  # hash of its template: what two lines have in common that differ in numbers and names only
    whole: int  # hash of all its words
    last: int  # hash of its last part, where it has several
    lead: int  # hash (a series of its own) of the template of its first part or sentence, where it has several, else 0
    figures: bool  # its template has a number
    fixed: bool  # its template has neither number nor name


def clean(line: str) -> str:
    if "&" in line:
        line = html.unescape(line)
    if "<" in line:
        line = _TAG.sub(" ", line)
    return line.strip(" \t\r\n ​")


def segments(line: str) -> list[str]:
    return [s.strip() for s in _SEPARATOR.split(line) if s.strip()]


def template(line: str) -> str:
    """A line with its numbers and its names (words within it with a capital) taken out, in lower case."""
    return _NUMBER.sub("0", _NAME.sub("\x01", " ".join(line.split())).lower())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def as_lead(frame: int) -> int:
    """The hash under which a template is counted as the beginning of a longer line."""
    return frame ^ 0x5BD1E995


def shape(line: str) -> str:
    """The shape of a cleaned line: clip, item, menu, figures, contact, table, prose or short; '' for an empty one."""
    if not line:
        return ""
    flat = " ".join(line.split())
    if _CLIPPED.search(flat):
        return "clip"
    if _ITEM.match(flat):
        return "item"
    parts = segments(line)
    contact = _CONTACT.search(flat)
    if len(parts) >= 3 and not contact and all(len(p.split()) <= 4 and not _SENTENCE.search(p) for p in parts):
        return "menu"
    if contact:
        return "contact"
    if sum(c.isdigit() for c in flat) * 8 >= len(flat):
        return "figures"
    if len(parts) >= 2 and not _SENTENCE.search(flat):
        return "table"
    if len(flat) >= 60 or _SENTENCE.search(flat):
        return "prose"
    return "short"


def read_lines(text: str) -> list[Line]:
    """Every line of a text that is not empty."""
    out = []
    for number, raw in enumerate(text.split("\n"), 1):
        line = clean(raw)
        kind = shape(line)
        if not kind:
            continue
        parts = _CRUMB.split(" ".join(line.split())) if kind in ("menu", "table", "short", "prose", "clip") else []
        frame = template(line)
        lead = _LEAD.match(line)
        out.append(
            Line(
                number, kind, _hash(frame), _hash(" ".join(line.lower().split())), _hash(parts[-1].lower()) if len(parts) > 1 else 0, as_lead(_hash(template(lead.group(1)))) if lead else 0,
                "0" in frame, "0" not in frame and "\x01" not in frame,
            )
        )
    return out
