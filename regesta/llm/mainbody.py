"""The main body of page texts, by the consensus of the pages on their frames and of a host's pages on the paths of their containers."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regesta.llm.lines import TEXT, Line, as_lead, read_lines
from regesta.session import materialise_with

#: What pages tell of a frame (a template that many hosts, or many pages of a host, have): the shares of its places inside a page's container, right before text or figures,
#: and right before the container. None: nothing yet.
Frame = tuple[float, float, float]
#: Rounds in which containers and frames are found from each other.
ROUNDS = 3
#: What a line with text of its own is worth to the container that holds it, by its shape.
WORTH = {"prose": 3.0, "item": 2.0, "contact": 2.0, "table": 2.0, "short": 1.0, "figures": 0.25}
#: What a frame is worth of which nothing is known yet.
DOUBTED = {"prose": -1.0, "short": -0.5}
#: A frame is worth nothing at this share of places inside containers; below it counts against a container, above it for it.
EVEN, STEEP = 0.25, 4.0
#: The share from which a frame counts as standing in containers only, and the one below which it counts as standing outside.
INSIDE, OUTSIDE = 0.85, 0.05
#: What is taken to hold for a frame with and without text of its own, before pages tell, and the number of places that this weighs.
PRIOR = {True: (1.0, 0.5, 0.0), False: (0.1, 0.3, 0.1)}
DOUBT = 4.0
#: The same for a template that only one host repeats: repetition itself speaks against it.
LOCAL_DOUBT = 1.0
_SHAPES = ("prose", "item", "contact", "table", "short", "figures", "menu", "clip")


def _own(told: Frame) -> float:
    """How much of a frame's places belong to a container: inside it, or right before it."""
    return told[0] + told[2]


def _heads(line: Line, told: Frame) -> bool:
    """A line that is the same everywhere and announces what follows: it hardly ever stands elsewhere, or hardly ever before anything else."""
    return line.fixed and (_own(told) >= INSIDE and told[1] >= 0.8 or _own(told) >= 0.3 and told[1] >= 0.85)


def _foreign(line: Line, frames: Mapping[int, Frame | None]) -> bool:
    """Does a line begin with what elsewhere stands, alone or as a beginning, outside containers?"""
    if not line.lead or line.shape in ("contact", "figures"):
        return False
    return any((told := frames.get(h)) is not None and _own(told) < OUTSIDE for h in (line.lead, as_lead(line.lead)))


def trail(lines: list[Line], k: int) -> bool:
    """Does the last part of a line name one of the lines right after it? Then it is the trail to that title."""
    return lines[k].last != 0 and any(x.whole == lines[k].last for x in lines[k + 1 : k + 4])


def line_worth(lines: list[Line], k: int, frames: Mapping[int, Frame | None]) -> float:
    """How much a line speaks for the container that holds it. Lines with text of their own do, menus, trails and clipped lines do not; a frame does as the pages say."""
    line = lines[k]
    if line.shape in ("menu", "clip") or trail(lines, k) or _foreign(line, frames):
        return -3.0
    base = WORTH[line.shape]
    if line.frame not in frames:
        return base if line.shape in TEXT else -0.25
    told = frames[line.frame]
    if told is None:
        return DOUBTED.get(line.shape, 0.0)
    if _heads(line, told):
        return base
    if line.figures and line.shape in ("short", "figures") and _own(told) < 0.5:
        return 0.0
    return base * max(-1.0, min(1.0, (told[0] - EVEN) * STEEP))


def span(worths: list[float]) -> tuple[int, int]:
    """First and last place of the run of greatest worth; (0, -1) if none is worth anything."""
    best, found = 0.0, (0, -1)
    total, start = 0.0, 0
    for k, worth in enumerate(worths):
        if total <= 0:
            total, start = 0.0, k
        total += worth
        if total > best:
            best, found = total, (start, k)
    return found


def container(lines: list[Line], frames: Mapping[int, Frame | None]) -> tuple[int, int]:
    """First and last place of the run of lines of greatest worth; (0, -1) if none is worth anything."""
    return span([line_worth(lines, k, frames) for k in range(len(lines))])


def _told(lines: list[Line], k: int, first: int, last: int) -> tuple[int, int, int]:
    """Does a line stand inside the container, before text or figures, and right before the container (figures between them aside)?"""
    after = lines[k + 1] if k + 1 < len(lines) else None
    announces = after is not None and (after.figures and after.shape != "prose" or after.shape in TEXT and first <= k + 1 <= last)
    begin = k + 1
    while begin < first and lines[begin].figures:
        begin += 1
    return int(first <= k <= last), int(announces), int(begin == first <= last and k < first)


def seen_frames(lines: list[Line], frames: Mapping[int, Frame | None]) -> Iterator[tuple[int, bool, int, int, int]]:
    """For every frame on a page: its hash, whether it has text, and what the page tells of it."""
    first, last = container(lines, frames)
    for k, line in enumerate(lines):
        for h in (line.frame, line.lead):
            if h in frames:
                yield h, h == line.frame and line.shape in TEXT, *_told(lines, k, first, last)


def host_votes(lines: list[Line], frames: Mapping[int, Frame | None]) -> dict[int, tuple[bool, int, int, int]]:
    """What a page tells of each of its templates. One that is no frame of many hosts has to stand inside the container without its own worth."""
    worths = [line_worth(lines, k, frames) for k in range(len(lines))]
    found = span(worths)
    places: dict[int, list[int]] = {}
    for k, line in enumerate(lines):
        for h in (line.frame, line.lead):
            if h:
                places.setdefault(h, []).append(k)
    out = {}
    for h, at in places.items():
        k = at[-1]
        text = h == lines[k].frame and lines[k].shape in TEXT
        if h in frames:
            out[h] = (text, *_told(lines, k, *found))
        else:
            doubted = worths.copy()
            for i in at:
                if lines[i].frame == h:
                    doubted[i] = DOUBTED.get(lines[i].shape, 0.0)
            out[h] = (text, *_told(lines, k, *(span(doubted) if doubted != worths else found)))
    return out


def line_kind(lines: list[Line], k: int, frames: Mapping[int, Frame | None]) -> str:
    """text, heading, title (a short line as titles are), entry (of a list), figures (a frame around numbers), label (one that goes with a page's text), aside or frame."""
    line = lines[k]
    if line.shape in ("menu", "clip") or trail(lines, k) or _foreign(line, frames):
        return "frame"
    told = frames.get(line.frame)
    if told is None:
        return "text" if line.shape in TEXT else "figures" if line.shape == "figures" else "entry"
    if line.shape in TEXT and told[0] >= EVEN:
        return "text"
    if line.figures and line.shape != "prose":
        if _own(told) >= 0.5:
            return "label"
        return "title" if line.shape == "short" and told[2] >= 0.1 and told[1] < 0.6 else "figures"
    if line.shape in TEXT:
        return "frame"
    if _heads(line, told):
        return "heading"
    if told[0] >= 0.5:
        return "aside" if line.fixed else "entry"
    return "title" if told[2] >= 0.1 and told[1] >= 0.2 else "frame"


def body_lines(lines: list[Line], frames: Mapping[int, Frame | None]) -> list[int]:
    """The numbers of the lines of the main body.

    That is the container with the title before it and the entries after it: its text, headings and title, figures that a heading announces, and short lines
    that stand in a list. Frames, labels and asides within it are not.
    """
    first, last = container(lines, frames)
    if first > last:
        return []
    kinds = [line_kind(lines, k, frames) for k in range(len(lines))]
    title = -1
    named = next((k for k in range(first, -1, -1) if trail(lines, k)), -1)
    if named >= 0:
        title = next(k for k in range(named + 1, len(lines)) if lines[k].whole == lines[named].last)
    else:
        k = first
        if kinds[k] not in ("title", "entry"):
            k -= 1
            while k >= 0 and kinds[k] in ("figures", "label", "aside"):
                k -= 1
        if k >= 0 and kinds[k] in ("title", "entry"):
            title = k
    if title >= 0:
        first = min(first, title)
    headed = kinds[last] == "heading"
    while last + 1 < len(lines) and (kinds[last + 1] in ("entry", "text") or headed and kinds[last + 1] == "figures"):
        last += 1
    kept = []
    announced = False
    for k in range(first, last + 1):
        kind = "title" if k == title else kinds[k]
        announced = kind == "heading" or announced and kind in ("figures", "label", "aside", "frame")
        own = kind in ("text", "heading") or k == title or kind == "figures" and announced
        if kind == "entry":
            own = any(0 <= s < len(lines) and (lines[s].shape in ("contact", "table", "item") or kinds[s] == "entry") for s in (k - 1, k + 1))
        if own:
            kept.append(lines[k].number)
    return kept


def leaned(told: tuple[bool, int, int, int, int], common: Frame | None, weight: float) -> Frame:
    """What pages (text or not, places, and the three counts) tell of a frame, leaning with a weight on what all hosts tell, or on the prior."""
    text, n, *counts = told
    base, w = common or PRIOR[bool(text)], weight
    return tuple((c + w * b) / (n + w) for c, b in zip(counts, base, strict=True))


_PAGE = "cache_path string, host string, number array<int>, shape array<tinyint>, frame array<long>, whole array<long>, last array<long>, lead array<long>, figures array<boolean>, fixed array<boolean>"
_TOLD = "h long, text boolean, n long, a long, b long, c long"


def _lines(row: tuple) -> list[Line]:
    return [Line(int(n), _SHAPES[s], int(f), int(w), int(la), int(le), bool(fi), bool(fx)) for n, s, f, w, la, le, fi, fx in zip(*row, strict=True)]


def _pages(batch: pd.DataFrame) -> Iterator[list[Line]]:
    return map(_lines, zip(*(batch[c] for c in ("number", "shape", "frame", "whole", "last", "lead", "figures", "fixed")), strict=True))


def main_body(pages: DataFrame, *, weight: float | None = 20.0, hosts_share: float = 0.01, pages_share: float = 5e-4, least: int = 3) -> DataFrame:
    """cache_path, ligne: the numbers (from 1, over all lines split at LF) of the lines of each page's main body.

    pages: cache_path (unique), domaine, texte. The texts have no tags, so a line's template (the line without its numbers and names) and its shape stand for
    tag and class. No phrase of any language is known beforehand:

    1. Templates that many hosts have (a share of them, and of the pages: so at most lines-per-page / pages_share, the bound of their broadcast) are frames.
    2. Each page's container is the run of lines of greatest worth: lines with text of their own count for it, menus, trails, clipped lines and frames
       against it. Over all pages each frame gets three votes: how often it stands inside a container, heads text, or stands right before a container. With
       these the containers are found again, ROUNDS times.
    3. The same votes are taken per host and template, on `least` pages of the host or more, leaning on the votes of all hosts with a weight, so
       that a host of few pages follows the others while what only one host repeats is judged by its own pages (weight None: no votes of hosts).
    4. The pages are read again with the votes of their hosts: container, title, headings, entries.

    Votes are combined before they are shuffled, so a host of a third of all pages costs one row per template and task; they reach the pages by a join on
    host and template that AQE may split. A page without text of its own has no main body; a null host is a host of its own; null texts give no
    line; an empty table gives no rows. Lines of any length are read whole.
    """
    spark = pages.sparkSession
    base = pages.where("texte is not null and cache_path is not null").select("cache_path", F.coalesce("domaine", F.lit("")).alias("host"), "texte")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_lines(t) for t in b["texte"]]
            out = {c: [[getattr(x, c) for x in ls] for ls in got] for c in ("number", "frame", "whole", "last", "lead", "figures", "fixed")}
            yield pd.DataFrame({"cache_path": b["cache_path"], "host": b["host"], **out, "shape": [[_SHAPES.index(x.shape) for x in ls] for ls in got]})

    own, seen = materialise_with(base.mapInPandas(read, _PAGE), "page-lines", pages=F.count(F.lit(1)))
    total = seen["pages"] or 0
    templates = F.array_distinct(F.filter(F.concat("frame", "lead"), lambda h: h != 0))
    by_host = own.select("host", F.explode(templates).alias("h")).groupBy("h", "host").agg(F.count("*").alias("n"))
    hosts = own.select("host").distinct().count()
    often = by_host.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("hosts")).where((F.col("hosts") >= F.lit(max(3.0, hosts_share * hosts))) & (F.col("n") >= F.lit(pages_share * total)))
    frames: dict[int, Frame | None] = {r.h: None for r in often.select("h").toLocalIterator()}

    for _ in range(ROUNDS):
        known = spark.sparkContext.broadcast(frames)

        def vote(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            votes: dict[int, list[int]] = {}
            for b in batches:
                for ls in _pages(b):
                    for h, text, *told in seen_frames(ls, known.value):
                        v = votes.setdefault(h, [0, 0, 0, 0, 0])
                        v[0], v[1] = v[0] | text, v[1] + 1
                        v[2:] = [x + y for x, y in zip(v[2:], told, strict=True)]
            yield pd.DataFrame([(h, bool(v[0]), *v[1:]) for h, v in votes.items()], columns=["h", "text", "n", "a", "b", "c"])

        told = own.mapInPandas(vote, _TOLD).groupBy("h").agg(F.bool_or("text").alias("text"), *(F.sum(x).alias(x) for x in "nabc"))
        frames = {r.h: leaned((r.text, r.n, r.a, r.b, r.c), None, DOUBT) for r in told.toLocalIterator()}

    known = spark.sparkContext.broadcast(frames)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes: dict[tuple[str, int], list[int]] = {}
            for host, ls in zip(b["host"], _pages(b), strict=True):
                for h, (text, *told) in host_votes(ls, known.value).items():
                    v = votes.setdefault((host, h), [0, 0, 0, 0, 0])
                    v[0], v[1] = v[0] | text, v[1] + 1
                    v[2:] = [x + y for x, y in zip(v[2:], told, strict=True)]
            yield pd.DataFrame([(host, h, bool(v[0]), *v[1:]) for (host, h), v in votes.items()], columns=["host", "h", "text", "n", "a", "b", "c"])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, votes, ls in zip(b["cache_path"], b["votes"], _pages(b), strict=True):
                mine = {v["h"]: leaned((v["text"], v["n"], v["a"], v["b"], v["c"]), known.value.get(v["h"]), weight if v["h"] in known.value else LOCAL_DOUBT) for v in votes} if votes is not None else {}
                rows += [(path, k) for k in body_lines(ls, ChainMap(mine, known.value) if mine else known.value)]
            yield pd.DataFrame(rows, columns=["cache_path", "ligne"])

    if weight is None:
        return own.withColumn("votes", F.lit(None).cast(f"array<struct<{_TOLD.replace(' ', ':').replace(',:', ',')}>>")).mapInPandas(extract, "cache_path string, ligne long")
    host_told = own.mapInPandas(local, f"host string, {_TOLD}").groupBy("host", "h").agg(F.bool_or("text").alias("text"), *(F.sum(x).alias(x) for x in "nabc")).where(F.col("n") >= least)
    page = [F.xxhash64("cache_path").alias("p1"), F.hash("cache_path").alias("p2")]
    votes = own.select(*page, "host", F.explode(templates).alias("h")).join(host_told, ["host", "h"]).groupBy("p1", "p2").agg(F.collect_list(F.struct("h", "text", "n", "a", "b", "c")).alias("votes"))
    return own.select("*", *page).join(votes, ["p1", "p2"], "left").drop("p1", "p2").mapInPandas(extract, "cache_path string, ligne long")
