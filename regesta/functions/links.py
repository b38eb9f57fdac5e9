"""Links between pages: what a link promises, and which may be followed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regesta.functions.keys import trimmed
from regesta.functions.text import normalise_name

# Words that make a link promising, with their weights.
PROMISING = (
    ("vie associative", 6), ("associ", 4), ("annuaire", 3), ("vie locale", 2), ("benevol", 2), ("club", 2), ("sport", 2), ("loisir", 2), ("culture", 2),
    ("forum", 1), ("jeunesse", 1), ("contact", 1),
)
# Words of sections that every town hall has and no association.
UNPROMISING = (
    "actualite", "agenda", "urbanisme", "etat civil", "mentions legales", "marche public", "marches publics", "compte rendu", "comptes rendus", "plan du site",
    "politique de confidentialite", "cookie", "connexion", "mon compte", "newsletter", "recherche", "deces", "naissance", "cimetiere", "cadastre",
    "permis de construire", "conseil municipal", "arrete", "dechet", "assainissement",
)
UNPROMISING_WEIGHT = -4
# File name extensions of what is no page.
NO_PAGE = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "rtf", "csv", "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "tif", "tiff",
    "zip", "rar", "7z", "gz", "tar", "mp3", "mp4", "avi", "mov", "wmv", "wav", "ogg", "css", "js", "json", "xml", "rss", "atom", "exe", "dmg", "apk",
)
# Second-level names of social networks.
SOCIAL = ("facebook", "fb", "messenger", "instagram", "linkedin", "twitter", "tiktok", "snapchat", "pinterest", "threads", "youtube", "youtu", "whatsapp", "telegram")

BEST_LINKS, MAX_DEPTH = 8, 2


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def path_and_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)


def link_score(url: Column, anchor: Column) -> Column:
    """The weights of promising words, in the address and in the anchor, less those of unpromising ones in either."""
    raw = path_and_query(url)
    # a plus sign stands for itself in a path
    path = normalise_name(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    words = normalise_name(F.coalesce(anchor, F.lit("")))
    # the two texts are bound once, by a one-element array, and the terms are a fold over a literal
    both = F.array(F.struct(path.alias("p"), words.alias("w")))
    good = F.array(*(F.struct(F.lit(w).alias("t"), F.lit(k).alias("k")) for w, k in PROMISING))
    bad = F.array(*map(F.lit, UNPROMISING))

    def value(x: Column) -> Column:
        plus = F.aggregate(good, F.lit(0), lambda s, g: s + F.when(x["p"].contains(g["t"]), g["k"]).otherwise(0) + F.when(x["w"].contains(g["t"]), g["k"]).otherwise(0))
        return F.aggregate(bad, plus, lambda s, t: s + F.when(x["p"].contains(t) | x["w"].contains(t), F.lit(UNPROMISING_WEIGHT)).otherwise(0))

    return F.element_at(F.transform(both, value), 1)


def is_social(name: Column) -> Column:
    labels = F.split(F.lower(name), r"\.")
    second = F.when(F.size(labels) >= 2, F.element_at(labels, F.greatest(F.size(labels) - 1, F.lit(1)))).otherwise(F.element_at(labels, 1))
    return second.isin(*SOCIAL) | (F.lower(name) == "x.com") | F.lower(name).endswith(".x.com")


def same_site(a: Column, b: Column) -> Column:
    """Two hosts but for www."""
    return F.regexp_replace(F.lower(a), r"^www\.", "") == F.regexp_replace(F.lower(b), r"^www\.", "")


def is_no_page(url: Column) -> Column:
    """Does the last part of the path end in the extension of something that is no page?"""
    last = F.regexp_extract(F.regexp_replace(path_and_query(url), r"\?.*$", ""), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"^.+\.([^.]*)$", 1)).isin(*NO_PAGE)


def town_hall_url(text: Column) -> Column:
    """A usable root address: http or https with a host, without its fragment; else null."""
    u = F.regexp_replace(trimmed(text), "#.*$", "")
    return F.when(u.rlike(r"^(?i)https?://[^\s/?#]+"), u)


def root_state(text: Column) -> Column:
    """What becomes of a municipality's address: 'invalide', 'refuse' (a social network) or 'a_explorer'."""
    u = town_hall_url(text)
    return F.when(u.isNull(), "invalide").when(is_social(host(u)), "refuse").otherwise("a_explorer")


def crawl_priority(depth: Column, score: Column) -> Column:
    """Smaller comes first: a band per depth, and within it the better score."""
    band = F.when(depth <= 0, 10).when(depth == 1, 80).otherwise(150)
    steps = F.greatest(F.lit(0), F.least(F.lit(39), F.floor(F.coalesce(score, F.lit(0.0)) * 4 + 0.5)))
    return (band + F.lit(39) - steps).cast("int")
