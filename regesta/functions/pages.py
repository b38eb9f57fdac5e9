"""HTML to text, links and blocks."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Elements without text of the page; those that break a line; those kept as blocks of context.
SKIPPED = frozenset(["script", "style", "noscript", "template", "svg", "head"])
BREAKING = frozenset(
    [
        "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "option",
        "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    ]
)
BLOCKS = frozenset(["td", "tr", "li", "dd", "p", "article"])
# The named characters that are decoded; others stay as they are written.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "ccedil": "ç", "ocirc": "ô",
    "ugrave": "ù", "icirc": "î", "euml": "ë", "iuml": "ï", "acirc": "â",
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag closes when its writer did not, up to the element that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
#: Elements whose opening closes an open paragraph.
CLOSE_P = BREAKING - {"br", "option", "td", "tr", "th", "tbody", "thead", "tfoot"}

LINK = StructType([StructField("href", StringType()), StructField("ancre", StringType())])
DOCUMENT = StructType([StructField("texte", StringType()), StructField("liens", ArrayType(LINK)), StructField("blocs", ArrayType(StructType([StructField("texte", StringType()), StructField("liens", ArrayType(LINK))])))])

_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|(\w+));")
_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:\-]+)""", re.IGNORECASE)


def decode_entities(text: str) -> str:
    def one(m: re.Match[str]) -> str:
        if m.group(3):
            return ENTITIES.get(m.group(3).lower(), m.group())
        code = int(m.group(1)) if m.group(1) else int(m.group(2), 16)
        return chr(code) if 0 < code <= 0x10FFFF else m.group()

    return _ENTITY.sub(one, text) if "&" in text else text


def tidy(text: str) -> str:
    """White space within lines becomes one space, runs of line ends one line end."""
    return re.sub(r" *\n\s*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip()


class _Reader(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=False)
        self.base = base
        self.pieces: list[str] = []
        self.links: list[list[str]] = []
        self.blocks: list[tuple[str, list[list[str]]]] = []
        self.open: list[tuple[str, int, int, bool]] = []  # tag, pieces and links before it, whether it is a link
        self.hidden = 0

    def _shut(self) -> None:
        tag, at, links, linked = self.open.pop()
        if tag in SKIPPED:
            self.hidden -= 1
            return
        if self.hidden:
            return
        if linked and links < len(self.links):
            self.links[links][1] = tidy("".join(self.pieces[at:]))
        if tag in BREAKING:
            self.pieces.append("\n")
        if tag in BLOCKS and (text := tidy("".join(self.pieces[at:]))):
            self.blocks.append((text, [list(x) for x in self.links[links:]]))

    def _shut_to(self, tags: set[str], within: set[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in within:
                return
            if self.open[depth][0] in tags:
                while len(self.open) > depth:
                    self._shut()
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self._shut_to(*CLOSES[tag])
        if tag in CLOSE_P:
            self._shut_to({"p"}, {"td", "th", "li", "dd", "article", "section", "div", "table"})
        if tag in BREAKING and not self.hidden:
            self.pieces.append("\n")
        at, links, linked = len(self.pieces), len(self.links), False
        if tag == "a" and not self.hidden:
            href = next((decode_entities(v) for k, v in attrs if k == "href" and v is not None), None)
            found = resolve(href, self.base) if href is not None else None
            if found is not None:
                self.links.append([found, ""])
                linked = True
        if tag in VOID:
            if tag in BREAKING and not self.hidden:
                self.pieces.append("\n")
            return
        self.open.append((tag, at, links, linked))
        if tag in SKIPPED:
            self.hidden += 1

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            while self.open[-1][0] != tag:
                self._shut()
            self._shut()

    def _text(self, text: str) -> None:
        if not self.hidden:
            self.pieces.append(text)

    handle_data = _text

    def handle_entityref(self, name: str) -> None:
        self._text(decode_entities(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self._text(decode_entities(f"&#{name};"))


def resolve(href: str, base: str) -> str | None:
    """The address of a link; null for what leads nowhere: nothing, a place on the page itself, or no address."""
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    try:
        url = urljoin(base, href)
        parts = urlsplit(url)
    except ValueError:
        return None
    if not parts.scheme:
        return None
    return url if parts.scheme not in ("http", "https") or parts.path else url.replace(parts.netloc, parts.netloc + "/", 1)


def read_html(html: str | None, base: str | None) -> dict:
    """The text of a page, its links and its blocks of context, inner ones first."""
    reader = _Reader(base or "")
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader._shut()
    pair = [dict(zip(("href", "ancre"), x, strict=True)) for x in reader.links]
    return {"texte": tidy("".join(reader.pieces)), "liens": pair, "blocs": [{"texte": t, "liens": [dict(zip(("href", "ancre"), x, strict=True)) for x in ls]} for t, ls in reader.blocks]}


def _documents(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_html(h, b) for h, b in zip(html, base, strict=True)], columns=["texte", "liens", "blocs"])


decode_text = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else decode_entities(t)), StringType())
tidy_text = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else tidy(t)), StringType())

#: (html, address) to a struct of text, links and blocks; one call for a page, batches over Arrow.
parse_page = F.pandas_udf(_documents, DOCUMENT)


def decode_bytes(body: bytes | None, content_type: str | None) -> str | None:
    """Text of a body: a byte-order mark tells its encoding, else the header, else the first 2 KiB, else UTF-8; what is not UTF-8 is read as Windows-1252."""
    if body is None:
        return None
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    header = re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:\-]+)", content_type or "", re.IGNORECASE)
    meta = _META.search(body[:2048])
    name = header.group(1) if header else meta.group(1).decode("ascii") if meta else "utf-8"
    if name.lower().replace("_", "-") in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):
        name = "windows-1252"  # as browsers read these
    try:
        codec = codecs.lookup(name).name
    except LookupError:
        codec = "utf-8"
    try:
        return body.decode(codec)
    except UnicodeDecodeError:
        return body.decode("windows-1252", "replace")


def _decode(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(b, c) for b, c in zip(body, content_type, strict=True)], dtype=object)


decode_page = F.pandas_udf(_decode, StringType())


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return content_type.isNull() | kind.isin("", "text/html", "application/xhtml+xml")
