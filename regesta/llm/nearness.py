"""Pairs of parsed names with own words near each other, found without an index on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of one group: a municipality with more is cut into as many parts of its keys, smaller ones share a group. Neither changes a result.
LEAST, MOST, GROUPS = 5_000, 50_000, 12
#: What is held at a time: keys, and pairs.
KEYS, PAIRS = 2_000_000, 1_000_000
#: Own words of a name that are looked at one by one; a name of more is kept whatever they are.
WORDS = 4

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_FAR = 128


def _powers(base: int) -> np.ndarray:
    out = [1]
    for _ in range(_FAR):
        out.append(out[-1] * base % (1 << 64))
    return np.array(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_BACK)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Texts as arrays: their lengths, the sums of their letters' values (so that the hash of any part is a difference), masks of letters (a bit for each that stands an odd number of times: an edit changes two at most, two letters changing places none) of all and of the first five, and these five."""

    def __init__(self, texts: list[str]) -> None:
        letters = np.array(texts, dtype=np.str_) if texts else np.zeros(0, dtype="<U1")
        width = max(letters.dtype.itemsize // 4, 1)
        codes = np.ascontiguousarray(letters).view(np.uint32).reshape(len(texts), width).astype(np.uint64)
        self.length = (codes > 0).sum(1)
        bits = np.where(codes > 0, np.uint64(1) << (codes % np.uint64(63)), np.uint64(0))
        self.mask = np.bitwise_xor.reduce(bits, axis=1)
        self.start = np.bitwise_xor.reduce(bits[:, :5], axis=1)
        self.letters = np.zeros((len(texts), width + 5), dtype=np.uint32)
        self.letters[:, :width] = codes
        self.five = np.bitwise_or.reduce((self.letters[:, :5].astype(np.uint64) & np.uint64(255)) << (np.arange(5, dtype=np.uint64) * np.uint64(8)), axis=1)
        self.first = np.uint64(1) << (codes[:, 0] % np.uint64(63))
        up = _UP[:width] if width <= _FAR else np.array([pow(_BASE, i, 1 << 64) for i in range(width)], dtype=np.uint64)
        self.sums = np.zeros((len(texts), width + 1), dtype=np.uint64)
        np.cumsum(np.where(codes > 0, _mixed(codes + np.uint64(1)) * up, np.uint64(0)), axis=1, out=self.sums[:, 1:])

    def without(self, rows: np.ndarray, length: int, edits: int) -> np.ndarray:
        """The hashes of texts of one length without up to `edits` of their letters (1 or 2), a row for each text. Texts within the edits, two letters changing places being one, have a hash in common."""
        c, one, two = self.sums[rows], _DOWN[1], _DOWN[2]
        end = c[:, length : length + 1]
        i = np.arange(length)
        parts = [end, c[:, i] + (end - c[:, i + 1]) * one]
        if edits > 1 and length > 1:
            i, j = np.triu_indices(length, 1)
            parts.append(c[:, i] + (c[:, j] - c[:, i + 1]) * one + (end - c[:, j + 1]) * two)
        return np.concatenate(parts, axis=1)

    def maybe(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Can two texts be near, by their lengths and letters?"""
        a, b = self.length[w], self.length[v]
        return (np.abs(a - b) <= 2) & (np.bitwise_count(self.mask[w] ^ self.mask[v]) <= np.where(np.minimum(a, b) < 6, 2, 4))

    def near(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Are two texts near: is variants.banded of them within variants.reach?"""
        at = np.flatnonzero(self.maybe(w, v))
        out = np.zeros(len(w), bool)
        for some in (at[i : i + PAIRS // 8] for i in range(0, len(at), PAIRS // 8)):
            a, b, la, lb = self.letters[w[some]], self.letters[v[some]], self.length[w[some]], self.length[v[some]]
            # five diagonals: j = i + o - 2
            older = row = np.broadcast_to(np.array([9, 9, 0, 1, 2], np.int8), (len(some), 5))
            end = np.full(len(some), 9, np.int8)
            for i in range(1, int(la.max(initial=0)) + 1):
                now = np.full((len(some), 5), 9, np.int8)
                for o in range(5):
                    j = i + o - 2
                    if j < 0 or j > b.shape[1]:
                        continue
                    if j == 0:
                        now[:, o] = i
                        continue
                    d = row[:, o] + (a[:, i - 1] != b[:, j - 1])
                    if o < 4:
                        d = np.minimum(d, row[:, o + 1] + 1)
                    if o > 0:
                        d = np.minimum(d, now[:, o - 1] + 1)
                    if i > 1 and j > 1:
                        d = np.where((a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1]), np.minimum(d, older[:, o] + 1), d)
                    now[:, o] = np.minimum(d, 9)
                over = np.flatnonzero(la == i)
                end[over] = now[over, lb[over] - la[over] + 2]
                older, row = row, now
            out[some] = end <= np.where(np.minimum(la, lb) < 6, 1, 2)
        return out

    def cut(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Can one of two texts of five letters and more, that are not near, be the other cut short save for an edit (variants._cut)?"""
        x = self.five[w] ^ self.five[v]
        same = sum(((x >> np.uint64(8 * k)) & np.uint64(255)) == 0 for k in range(5))
        return (same >= 4) | (same == 3) & (self.start[w] == self.start[v])

    def part(self, rows: np.ndarray, start: int, stop: int) -> np.ndarray:
        return (self.sums[rows, stop] - self.sums[rows, start]) * (_DOWN[start] if start <= _FAR else np.uint64(pow(_BACK, start, 1 << 64)))


def _edits(length: int) -> int:
    """As variants.reach."""
    return 1 if length < 6 else 2


def _keys(texts: Texts, rows: np.ndarray, salt: np.ndarray, chosen: Callable[[np.ndarray], np.ndarray], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The chosen keys of units (a text each, and a salt), with the units' numbers; only: those that are in these sorted ones."""
    keys, units = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    lengths = texts.length[rows]
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(1, KEYS // (1 + int(n) * (int(n) + 1)))
        for some in (at[i : i + step] for i in range(0, len(at), step)):
            got = _mixed(texts.without(rows[some], int(n), _edits(int(n))) + salt[some, None])
            keep = chosen(got)
            found, unit = got[keep], np.broadcast_to(some[:, None], got.shape)[keep]
            if only is not None:
                there = only[np.minimum(np.searchsorted(only, found), len(only) - 1)] == found if len(only) else np.zeros(len(found), bool)
                found, unit = found[there], unit[there]
            keys.append(found)
            units.append(unit)
    return np.concatenate(keys), np.concatenate(units)


def _expanded(counts: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows with counts: the row and the place in it, some at a time."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        some = counts[at:stop]
        rows = np.repeat(np.arange(at, stop), some)
        yield rows, np.arange(len(rows)) - np.repeat(np.cumsum(some) - some, some)
        at = stop


def _equal_pairs(keys: np.ndarray, units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(keys)
    keys, units = keys[order], units[order]
    ends = np.searchsorted(keys, keys, side="right")
    for rows, place in _expanded(ends - np.arange(len(keys)) - 1):
        yield units[rows], units[rows + 1 + place]


def _met(keys: np.ndarray, units: np.ndarray, held: np.ndarray, holders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units and the holders of equal keys, held being sorted."""
    start = np.searchsorted(held, keys, side="left")
    for rows, place in _expanded(np.searchsorted(held, keys, side="right") - start):
        yield units[rows], holders[start[rows] + place]


class Units:
    """Different (salt, text) of names, and the names of each."""

    def __init__(self, names: np.ndarray, texts: np.ndarray, salts: np.ndarray) -> None:
        order = np.lexsort((texts, salts))
        names, texts, salts = names[order], texts[order], salts[order]
        new = np.ones(len(names), bool)
        new[1:] = (texts[1:] != texts[:-1]) | (salts[1:] != salts[:-1])
        self.names, self.start = names, np.flatnonzero(new)
        self.text, self.salt = texts[self.start], salts[self.start]
        self.size = np.diff(np.append(self.start, len(names)))

    def of(self, units: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The names of units, each with what stands beside its unit."""
        for rows, place in _expanded(self.size[units]):
            yield self.names[self.start[units[rows]] + place], others[rows]


def _unique(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(a * width + b)
    return both // width, both % width


class Group:
    """The names of some municipalities (or of one, or of none), and those that know none, which meet all of them."""

    def __init__(self, b: pd.DataFrame, own_null: bool, parts: int, part: int) -> None:
        self.n = b["n"].to_numpy(np.int64)
        null = b["code"].isna().to_numpy()
        self.probing = null & (not own_null)
        place = np.where(null, 0, pd.factorize(b["code"])[0] + 1).astype(np.uint64)
        self.salt = _mixed(place + np.uint64(7))
        self.parts, self.part = parts, part
        words = [c.split() for c in b["core"]]
        self.bare = np.array([not w for w in words], dtype=bool)
        spoken = [sorted({*w, *(x + y for i, x in enumerate(w) for j, y in enumerate(w) if i != j)}) if bare else [] for w, bare in zip((w.split() for w in b["bare"]), self.bare, strict=True)]
        number: dict[str, int] = {}
        self.name_of, self.text_of = (np.array(x, dtype=np.int64) for x in ([i for i, w in enumerate(words) for _ in w] + [i for i, w in enumerate(spoken) for x in w if len(x) >= 4], [number.setdefault(x, len(number)) for w in words for x in w] + [number.setdefault(x, len(number)) for w in spoken for x in w if len(x) >= 4]))
        self.texts = Texts(list(number))
        self.count = np.array([len(w) for w in words], dtype=np.int64)
        # own words one by one
        column = np.concatenate([np.arange(k) for k in self.count] or [np.zeros(0, int)]).astype(np.int64)
        seen = column < WORDS
        self.word = np.full((len(words), WORDS), -1, dtype=np.int64)
        self.word[self.name_of[: len(column)][seen], column[seen]] = self.text_of[: len(column)][seen]
        tokens = {t for p in set(b["place"]) for t in p.split()}
        self.in_place = np.fromiter((w in tokens for w in number), bool, len(number))
        bit = {w: 1 << (int.from_bytes(w[:3].encode()) % 63) for w in number}
        self.head = np.fromiter(bit.values(), np.uint64, len(number))

        def masks(values: pd.Series, of: Callable[[str], int]) -> np.ndarray:
            known = {v: of(v) for v in set(values)}
            return np.array([known[v] for v in values], dtype=np.uint64)

        def heads(v: str) -> int:
            out = 0
            for w in v.split():
                out |= 1 << (int.from_bytes(w[:3].encode()) % 63) if len(w) > 3 else 0
            return out

        def initials(v: str) -> int:
            out = 0
            for s in v.split():
                for c in s[1:]:
                    out |= 1 << (ord(c) % 63)
            return out

        self.heads, self.initials = masks(b["known"], heads), masks(b["sig"], initials)
        self.short = b["short"].to_numpy(bool)
        longest = np.where(self.word >= 0, self.texts.length[self.word] if len(number) else 0, 0)
        self.long = longest.max(1, initial=0) >= 10
        self.cores = words

    def chosen(self, rounds: int, r: int) -> Callable[[np.ndarray], np.ndarray]:
        parts, part = np.uint64(self.parts * rounds), np.uint64(self.part + self.parts * r)
        return lambda keys: keys % parts == part if parts > 1 else np.ones(keys.shape, bool)

    def explained(self, a: np.ndarray, b: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Can each own word of names a be near one of names b, cut short there, part of words written as one, or what own_distance explains otherwise? And is one near?"""
        ok, some = np.ones(len(a), bool), np.zeros(len(a), bool)
        t = self.texts
        for i in range(WORDS):
            at = np.flatnonzero(self.count[a] > i)
            if not len(at):
                break
            x, y = a[at], b[at]
            w = self.word[x, i]
            good = self.in_place[w] | self.short[y] | (self.head[w] & self.heads[y] > 0) | (t.first[w] & self.initials[y] > 0)
            good |= (t.length[w] >= 10) & (self.count[y] >= 3) | (self.count[x] >= 3) & self.long[y]
            for j in range(WORDS):
                to = np.flatnonzero(self.count[y] > j)
                v = self.word[y[to], j]
                close = near(w[to], v)
                some[at[to]] |= close
                good[to] |= close | t.cut(w[to], v)
            ok[at] &= good
        return ok, some

    def kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that compare may accept or mine: a word is near, and on one side at least no own word is left over."""
        whole = self.bare[a] | self.bare[b] | (self.count[a] > WORDS) | (self.count[b] > WORDS)
        out = whole.copy()
        at = np.flatnonzero(~whole)
        for near in (self.texts.maybe, self.texts.near):  # first what costs little
            first, some = self.explained(a[at], b[at], near)
            rest = np.flatnonzero(~first & some)
            first[rest] = self.explained(b[at[rest]], a[at[rest]], near)[0]
            at = at[first & some]
        out[at] = True
        return out

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        total = len(self.n)
        found = [np.zeros(0, np.int64)]

        def take(a: np.ndarray, b: np.ndarray, sure: bool = False) -> None:
            at = (a != b) & ~(self.bare[a] & self.bare[b])
            a, b = a[at], b[at]
            a, b = _unique(np.minimum(a, b), np.maximum(a, b), total)
            if not sure:
                at = self.kept(a, b)
                a, b = a[at], b[at]
            found.append(a * total + b)

        def names(left: Units, u: np.ndarray, right: Units, v: np.ndarray) -> None:
            for a, w in left.of(u, v):
                for b, x in right.of(w, a):
                    take(x, b)

        own = ~self.probing[self.name_of]
        bare = self.bare[self.name_of]
        inside = Units(self.name_of[own], self.text_of[own], self.salt[self.name_of[own]] + bare[own].astype(np.uint64))
        spoken = np.zeros(len(inside.text), bool)
        spoken[:] = self.bare[inside.names[inside.start]]
        nothing = lambda u: np.zeros(len(u.text), np.uint64)
        anywhere = Units(self.name_of[own], self.text_of[own], np.zeros(own.sum(), np.uint64))
        strange = Units(self.name_of[~own], self.text_of[~own], np.zeros((~own).sum(), np.uint64))
        lengths = self.texts.length
        size = sum(int((1 + lengths[u.text] * (lengths[u.text] + 1) // 2).sum()) for u in (inside, strange))
        rounds = 1 + size // (self.parts * KEYS)
        if self.part == 0:
            same = np.flatnonzero((inside.size > 1) & ~spoken)
            names(inside, same, inside, same)
        for r in range(rounds):
            chosen = self.chosen(rounds, r)
            # a name without own words is of the same salt but for one
            salts = inside.salt - spoken.astype(np.uint64)
            for u, v in _equal_pairs(*_keys(self.texts, inside.text, salts, chosen)):
                at = (u != v) & ~(spoken[u] & spoken[v])
                names(inside, *((w := _unique(np.minimum(u[at], v[at]), np.maximum(u[at], v[at]), len(spoken)))[0], inside, w[1]))
            if len(strange.text):
                keys, units = _keys(self.texts, strange.text, nothing(strange), chosen)
                order = np.argsort(keys)
                keys, units = keys[order], units[order]
                for u, v in _met(*_keys(self.texts, anywhere.text, nothing(anywhere), chosen, keys), keys, units):
                    names(anywhere, *((w := _unique(u, v, len(strange.text)))[0], strange, w[1]))
        self.joined(inside, anywhere, strange, take)
        both = np.unique(np.concatenate(found))
        return both // max(total, 1), both % max(total, 1)

    def joined(self, inside: Units, anywhere: Units, strange: Units, take: Callable[..., None]) -> None:
        """Two words of a name, written as one, and the long words of others: they have one of three parts in common, shifted by the edits."""
        several: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(self.cores):
            for i, x in enumerate(w) if len(w) > 1 else ():
                for j, y in enumerate(w):
                    if i != j:
                        several.setdefault(len(x) + len(y), []).append((k, x + y))
        for m, some in several.items():
            name = np.array([k for k, _ in some], dtype=np.int64)
            whole = Texts([x for _, x in some])
            own = np.flatnonzero(~self.probing[name])
            away = np.flatnonzero(self.probing[name])
            here, nowhere = self.salt[name], np.zeros(len(name), np.uint64)
            for units, rows, salts in ((inside, own, here), (strange, own, nowhere), (anywhere, away, nowhere)):
                length = self.texts.length[units.text]
                probing = np.flatnonzero((length >= 8) & (np.abs(length - m) <= 2))
                if len(rows) and len(probing):
                    salt = self.salt[units.names[units.start]] if units is inside else np.zeros(len(units.text), np.uint64)
                    self._joined(m, units, probing, salt, whole, rows, salts, name, take)

    def _joined(self, m: int, units: Units, probing: np.ndarray, salt: np.ndarray, whole: Texts, rows: np.ndarray, salts: np.ndarray, name: np.ndarray, take: Callable[..., None]) -> None:
        length, at = self.texts.length[units.text[probing]], [i * m // 3 for i in range(4)]
        for i in range(3):
            tag, size = np.uint64((m * 4 + i) * 0xD6E8FEB86659FD93 % (1 << 64)), at[i + 1] - at[i]
            held = _mixed(whole.part(rows, at[i], at[i + 1]) + salts[rows] + tag)
            order = np.argsort(held)
            held, holders = held[order], rows[order]
            for n in map(int, np.unique(length)):
                some, gap = probing[length == n], n - m
                text = units.text[some]
                for p in range(max(0, at[i] - i, at[i] + gap - (2 - i)), min(n - size, at[i] + i, at[i] + gap + (2 - i)) + 1):
                    hashes = [self.texts.part(text, p, p + size)]
                    if i < 2 and p + size < n:  # its last letter as it was before it changed places with the next one
                        hashes.append(self.texts.part(text, p, p + size - 1) + self.texts.part(text, p + size, p + size + 1) * _UP[size - 1])
                    for h in hashes:
                        keys = _mixed(h + salt[some] + tag)
                        mine = np.flatnonzero(self.chosen(1, 0)(keys))
                        for u, v in _met(keys[mine], some[mine], held, holders):
                            near = np.bitwise_count(self.texts.mask[units.text[u]] ^ whole.mask[v]) <= 4
                            for a, w in units.of(u[near], v[near]):
                                take(a, name[w], True)


def _bare(c: str) -> Column:
    return F.when(F.size("core") == 0, F.array_join(F.array_sort(F.concat("known", "short", "sig")), " ")).otherwise("").alias(c)


def near_names(names: DataFrame) -> DataFrame:
    """a, b, sides: nodes whose names variants.compare may find to be of one body, or differing in words to be mined; of one municipality, or one of the two unknown.

    Own words are near where they have a hash in common after up to two letters (one, if shorter than six) are taken out; a pair of names is kept where, on one side, all own
    words can be near ones or are explained. Nothing but names is shuffled: municipalities share groups of bounded size, names that know none go to every group, and a municipality of more
    names than a group has several, each with a part of its keys. sides: 2 for two nodes of a register (a < b), 1 for an entry (then a) and a node of the register, 0 for two entries.
    """
    counts = names.groupBy("code").agg(F.count("*").alias("k"), F.count_if(_bare("bare") != "").alias("bare"))
    row = counts.agg(F.sum("k").alias("total"), F.sum("bare").alias("bare"), F.sum(F.when(F.col("code").isNull(), F.col("k"))).alias("none"), F.collect_list(F.when(F.col("code").isNotNull() & (F.col("k") > LEAST), F.struct("code", "k"))).alias("large")).first()
    total, none = row.total or 0, row.none or 0
    per = min(MOST, max(LEAST, total // GROUPS))
    large = {r.code: -(-r.k // per) for r in row.large if r.k > per}
    bins = max(1, -(-(total - none - sum(r.k for r in row.large if r.code in large)) // per))
    spec = {i: (False, 1, 0) for i in range(bins)}
    first: dict[str, int] = {}
    for code, parts in sorted(large.items()):
        first[code] = len(spec)
        spec |= {len(spec) + i: (False, parts, i) for i in range(parts)}
    met = len(spec)
    parts = max(1, -(-none // per))
    spec |= {met + i: (True, parts, i) for i in range(parts)}
    groups = F.when(F.col("code").isNull(), F.sequence(F.lit(0), F.lit(len(spec) - 1))).otherwise(F.array(F.pmod(F.xxhash64("code"), F.lit(bins)).cast("int")))
    for code, i in first.items():
        groups = F.when(F.col("code") == code, F.sequence(F.lit(i), F.lit(i + large[code] - 1))).otherwise(groups)
    signs = F.array_join(F.concat("sig", F.when(F.size("sig") > 0, F.array(F.coalesce("sigle", F.lit("")))).otherwise(F.array().cast("array<string>"))), " ").alias("sig")
    told = names.select("n", "side", "code", F.array_join("core", " ").alias("core"), F.array_join("known", " ").alias("known"), signs, F.exists("short", lambda w: F.length(w) >= 3).alias("short"), F.coalesce("place", F.lit("")).alias("place"), _bare("bare"), F.explode(groups).alias("part"))

    def near(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        a, c = Group(b, *spec[int(key[0])]).found()
        n, side = b["n"].to_numpy(), b["side"].to_numpy()
        turned = (side[a] > side[c]) | ((side[a] == side[c]) & (n[a] > n[c]))
        return pd.DataFrame({"a": np.where(turned, n[c], n[a]), "b": np.where(turned, n[a], n[c]), "sides": (side[a] + side[c]).astype(np.int32)})

    pairs = told.repartition(len(spec), "part").groupBy("part").applyInPandas(near, "a long, b long, sides int")
    if not row.bare:
        return pairs.distinct()
    # names without own words and with the same others
    bare = names.where(F.size("core") == 0).select(F.col("n").alias("x"), F.col("side").alias("sx"), F.col("code").alias("cx"), _bare("bare")).where("bare <> ''")
    other = bare.toDF("y", "sy", "cy", "bare")
    before = (F.col("sx") < F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y")))
    found = [bare.join(other.where("cy is not null"), (F.col("cx") == F.col("cy")) & (bare["bare"] == other["bare"])), bare.where("cx is null").join(other, bare["bare"] == other["bare"])]
    for met in found:
        met = met.where(F.col("x") != F.col("y"))
        pairs = pairs.unionByName(met.select(F.when(before, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(before, F.col("y")).otherwise(F.col("x")).alias("b"), (F.col("sx") + F.col("sy")).alias("sides")))
    return pairs.distinct()
