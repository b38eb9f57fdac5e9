"""Text as it compares: names without accents."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signs that carry the Unicode property Diacritic without being combining marks, as far as Latin text has them.
_SPACING_DIACRITICS = "^`¨¯´·¸"

_NOT_ALNUM = re.compile(r"[^a-z0-9]+")
MARKS = re.compile(rf"[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯{re.escape(_SPACING_DIACRITICS)}]")


def plain_name(text: str) -> str:
    """Lower case, no accents, everything but letters and digits one space."""
    return _NOT_ALNUM.sub(" ", MARKS.sub("", unicodedata.normalize("NFD", text)).lower()).strip()


def _names(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else plain_name(v))


#: The exact form, for any script; batches over Arrow.
normalise_name_exact = F.pandas_udf(_names, StringType())


def _latin_table() -> tuple[str, str]:
    """Letters of the two Latin blocks that decompose to one base letter, and their base letters."""
    pairs = [(chr(c), MARKS.sub("", unicodedata.normalize("NFD", chr(c)))) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _latin_table()


def normalise_name(text: Column) -> Column:
    """normalise_name_exact for Latin text, inside the JVM: letters outside the Latin blocks become spaces."""
    bare = F.regexp_replace(F.translate(text, _FROM + _SPACING_DIACRITICS, _TO), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))
