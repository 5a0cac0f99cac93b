"""Freely typed values mapped to the closest entry of a reference list.

Reference entries are held in BK-trees under the unrestricted
Damerau-Levenshtein distance, which is a metric, so the triangle inequality
prunes exactly: a search returns every entry within the threshold.  A tree is
walked by all queries of a batch at once: a node's distances to the queries
that reach it are worked out in numpy, and each child gets those queries that
the inequality leaves.  A list of more than ``SHARD`` entries is split into
shards, each searched on its own; the shards' winners are then merged.

The queries are the windows of a title, wherever they stand.  A name cut short
by a full stop is searched in a second tree, of the beginnings that belong to
one entry alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.session import spread

#: Entries of the reference list that one tree, and so one broadcast, may hold.
SHARD = 50_000
#: Shards a reference list may come in; beyond it the list is no reference list but a table to join.
MOST_SHARDS = 8
#: Queries below which a node's distances are worked out one by one.
FEW = 6

# Words before a name that are no part of it, words after which a name is a mention in passing, and words of a company's form.
NOT_YET = frozenset(["sale", "deal", "new", "hot", "original", "offer", "top", "best", "genuine", "promo", "used", "refurbished", "by", "from", "the"])
PASSING = frozenset(["for", "fits", "replaces", "like", "with", "compatible", "vs", "versus", "than", "as", "beside", "unlike"])
COMPANY = ("electronics", "international", "inc", "corp", "corporation", "ltd", "gmbh", "company", "bay")


def name_form(text: str) -> str:
    """Letters and digits of a name, lower-case, without accents."""
    if text.isascii():
        return re.sub(r"[^a-z0-9]", "", text.lower())
    out = unicodedata.normalize("NFD", text.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l"))
    return re.sub(r"[^a-z0-9]", "", out)


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: edits, with swaps of neighbours, substrings edited more than once allowed."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            same = x == y
            if same:
                seen = j
            row.append(min(rows[i][j] + (not same), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def distances(name: str, codes: np.ndarray) -> np.ndarray:
    """The same distance between one name and many of equal length, given as rows of character codes."""
    q, length = codes.shape
    n, at = len(name), np.arange(q)
    grid = np.full((length + 2, n + 2, q), length + n, dtype=np.int16)
    grid[1, 1:] = np.arange(n + 1, dtype=np.int16)[:, None]
    grid[1:, 1] = np.arange(length + 1, dtype=np.int16)[:, None]
    last = {y: np.zeros(q, dtype=np.int64) for y in name}
    for i in range(1, length + 1):
        x = codes[:, i - 1]
        seen = np.zeros(q, dtype=np.int64)
        for j, y in enumerate(name, 1):
            same = x == ord(y)
            best = np.minimum(grid[i + 1, j], grid[i, j + 1]) + 1
            np.minimum(best, grid[i, j] + ~same, out=best)
            k = last[y]
            swap = np.flatnonzero((k > 0) & (seen > 0))
            if len(swap):
                k, m = k[swap], seen[swap]
                best[swap] = np.minimum(best[swap], grid[k, m, at[swap]] + (i - k) + (j - m) - 1)
            grid[i + 1, j + 1] = best
            seen[same] = j
        for y, rows in last.items():
            rows[x == ord(y)] = i
    return grid[length + 1, n + 1]


def letters_of(form: str) -> int:
    """Set of a name's characters, as bits."""
    bits = 0
    for c in form:
        bits |= 1 << (ord(c) - 48 & 63)
    return bits


class Node:
    """An entry, its children by their distance to it, and what holds for the whole subtree: letters of any and of all names, lengths."""

    __slots__ = ("form", "entries", "children", "own", "some", "every", "shortest", "longest")

    def __init__(self, form: str, entry: int):
        self.form, self.entries, self.children = form, [entry], {}
        self.own = self.some = self.every = letters_of(form)
        self.shortest = self.longest = len(form)


class BKTree:
    """Entries by distance to their parent; equal forms share a node."""

    def __init__(self, entries: Iterable[tuple[str, int]]):
        self.root: Node | None = None
        for form, entry in entries:
            self.add(form, entry)

    @property
    def longest(self) -> int:
        return self.root.longest if self.root else 0

    def add(self, form: str, entry: int) -> None:
        if self.root is None:
            self.root = Node(form, entry)
            return
        node, bits = self.root, letters_of(form)
        while True:
            node.some |= bits
            node.every &= bits
            node.shortest, node.longest = min(node.shortest, len(form)), max(node.longest, len(form))
            d = distance(form, node.form)
            if d == 0:
                node.entries.append(entry)
                return
            if d not in node.children:
                node.children[d] = Node(form, entry)
                return
            node = node.children[d]

    def within(self, form: str, most: int) -> list[tuple[int, str, int]]:
        """All (distance, form, entry) with a distance of at most ``most``."""
        return self.search([form], most)[0]

    def search(self, forms: list[str], most: int) -> list[list[tuple[int, str, int]]]:
        """``within`` of many names at once.

        A query leaves a subtree by the triangle inequality, and where it has
        more than ``most`` letters that no name there has, lacks more than
        ``most`` that all have, or is too long or too short for all: each such
        letter costs an edit.
        """
        found: list[list[tuple[int, str, int]]] = [[] for _ in forms]
        by_length: dict[int, list[int]] = {}
        for i, form in enumerate(forms):
            by_length.setdefault(len(form), []).append(i)
        for length, group in by_length.items() if self.root else ():
            if not self.root.shortest - most <= length <= self.root.longest + most:
                continue
            codes = np.frombuffer("".join(forms[i] for i in group).encode("ascii"), dtype=np.uint8).reshape(len(group), length)
            bits = np.zeros(len(group), dtype=np.uint64)
            for column in codes.T:
                bits |= np.uint64(1) << ((column - np.uint8(48)) & np.uint8(63)).astype(np.uint64)
            stack = [(self.root, np.arange(len(group)))]
            while stack:
                node, at = stack.pop()
                if not node.shortest - most <= length <= node.longest + most:
                    continue
                b = bits[at]
                at = at[(np.bitwise_count(b & ~np.uint64(node.some)) <= most) & (np.bitwise_count(np.uint64(node.every) & ~b) <= most)]
                if not len(at):
                    continue
                d = distances(node.form, codes[at]) if len(at) >= FEW else np.array([distance(forms[group[i]], node.form) for i in at])
                for i in np.flatnonzero(d <= most):
                    found[group[at[i]]].extend((int(d[i]), node.form, e) for e in node.entries)
                for edge, child in node.children.items():
                    near = at[np.abs(d - edge) <= most]
                    if len(near):
                        stack.append((child, near))
        return [sorted(x) for x in found]


def beginnings(entries: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Beginnings of two letters or more that are those of one entry alone, with the entry."""
    owner: dict[str, int | None] = {}
    for form, entry in entries:
        for n in range(2, len(form)):
            owner[form[:n]] = entry if owner.get(form[:n], entry) == entry else None
    return [(form, entry) for form, entry in owner.items() if entry is not None]


def allowed(form: str, leading: bool = True) -> int:
    """Edits allowed for a name at a title's head: two from six letters on, else one; none below four.  One fewer elsewhere."""
    most = 2 if len(form) >= 6 else 1 if len(form) >= 4 else 0
    return most if leading else max(most - 1, 0)


def ordinary_words(titles: DataFrame, share: float = 0.002, least: int = 20) -> frozenset[str]:
    """Forms of the words that stand behind the second place in at least ``share`` of all titles.

    Counted over all titles and whole titles; at most (average words per title
    / share) words come back.  Such a word is no misspelt name.
    """
    every = F.split(F.lower("title"), r"\s+")
    words = titles.filter("title is not null").select(F.explode(F.slice(every, F.lit(3), F.greatest(F.size(every), F.lit(1)))).alias("w"))
    total = titles.count()
    rows = words.groupBy("w").count().filter(F.col("count") >= max(least, share * total)).select("w").collect()
    return frozenset(name_form(r[0]) for r in rows)


_WORDS = re.compile(r"[^\s,;|()\[\]]+")
_FIRM = re.compile(rf"(?i)-(?:{'|'.join(COMPANY)})$")


class Search:
    """A shard's two trees and what they answered before."""

    def __init__(self, entries: list[tuple[str, int]], most_words: int, ordinary: frozenset[str] = frozenset()):
        self.tree, self.begun = BKTree(entries), BKTree(beginnings(entries))
        self.most_words, self.ordinary = most_words, ordinary
        self.letters = frozenset(c for form, _ in entries for c in form)
        self.known: dict[tuple[str, int], list[tuple[int, str, int]]] = {}
        self.words: dict[str, tuple[str, int, bool, bool]] = {}

    def word(self, text: str) -> tuple[str, int, bool, bool]:
        """(form, letters that no entry has, is it ordinary, does it make what follows a mention in passing)."""
        if text not in self.words:
            if len(self.words) > 500_000:
                self.words.clear()
            form = name_form(_FIRM.sub("", text) if "-" in text else text)
            self.words[text] = (form, sum(c not in self.letters for c in form), form in self.ordinary, form in PASSING)
        return self.words[text]

    def windows(self, title: str | None) -> list[tuple[str, bool, bool, int]]:
        """(form, is it cut short by a full stop, does it stand at the head, edits to search with) of every run of words that may be a name.

        Words of advertising before the name are passed over, so that the next
        word is at the head still.  A run that follows a word like "fits" or
        "replaces" is a mention in passing and left out; a dash parts runs.  A
        run of ordinary words alone must be a name as it is; elsewhere than at
        the head one edit is searched.  Runs that are too long, or have more
        foreign letters than edits, are near no entry and left out.
        """
        texts = _WORDS.findall(title or "")
        if not texts:
            return []
        words = [self.word(w) for w in texts]
        first = 0
        while first < len(words) - 1 and words[first][0] in NOT_YET:
            first += 1
        out: dict[tuple[str, bool, bool, int], None] = {}
        for start in range(first, len(words)):
            leading = start == first
            if not leading and words[start - 1][3]:
                continue
            most = 2 if leading else 1
            joined, foreign, usual = "", 0, True
            for at in range(start, min(start + self.most_words, len(words))):
                form, strange, ordinary, passing = words[at]
                if joined and passing or texts[at] in ("-", "–"):
                    break
                joined += form
                foreign += strange
                usual = usual and ordinary
                if foreign > most or len(joined) > self.tree.longest + most:
                    break
                if len(joined) > 1:
                    out[joined, texts[at][-1] == ".", leading, 0 if usual or len(joined) < 3 else most] = None
        return list(out)

    def learn(self, queries: Iterable[list[tuple[str, bool, bool, int]]]) -> None:
        """Search the runs that are new; what is known is forgotten when it grows large."""
        if len(self.known) > 500_000:
            self.known.clear()
        new: dict[int, dict[str, None]] = {-1: {}, 0: {}, 1: {}, 2: {}}  # by edits; -1 for the tree of beginnings
        for query in queries:
            for form, cut, _, most in query:
                if (form, most) not in self.known:
                    new[most][form] = None
                if cut and (form, -1) not in self.known:
                    new[-1][form] = None
        for most, forms in ((m, list(f)) for m, f in new.items()):
            for i in range(0, len(forms), 200_000):
                part = forms[i : i + 200_000]
                found = self.tree.search(part, most) if most >= 0 else self.begun.search(part, 0)
                self.known.update(zip(((f, most) for f in part), found, strict=True))

    def best(self, queries: list[tuple[str, bool, bool, int]]) -> tuple[int, int, int] | None:
        """(distance, entry, number of entries that near) of the best of a title's runs, or None.

        The nearest entry within the threshold of the longer of the two names
        holds; ties go to the head and there to the longer run, elsewhere to
        the earlier one, then to the smaller entry.  A beginning that a full
        stop cuts short stands for its entry unless the run is an entry in full.
        """
        best = None
        for n, (form, cut, leading, most) in enumerate(queries):
            found = self.known[form, most]
            if found:
                near = max(allowed(form, leading), allowed(found[0][1], leading))
                found = [x for x in found if x[0] <= near]
            if cut and not (found and found[0][0] == 0):
                found = self.known[form, -1] or found
            if found:
                d = found[0][0]
                rank = (d, not leading, -n if leading else n)
                if best is None or rank < best[0]:
                    best = (rank, found[0][2], len({x[2] for x in found if x[0] == d}))
        return (best[0][0], best[1], best[2]) if best else None


_searches: dict[tuple, Search] = {}


def _search(shard, most_words: int, ordinary: frozenset[str]) -> Search:
    """The worker's trees of a broadcast shard; a worker that is used again finds them."""
    entries = shard.value
    key = (len(entries), hash(tuple(entries)), most_words, ordinary)
    if key not in _searches:
        if len(_searches) >= 2:
            _searches.clear()
        _searches[key] = Search(entries, most_words, ordinary)
    return _searches[key]


def reference_shards(reference: DataFrame, id_col: str, name_col: str) -> tuple[list[list[tuple[str, int]]], int]:
    """Forms and ids of the reference list in shards of at most SHARD entries, and the most words of a name.

    Null names and names without letters or digits are left out.  More than
    MOST_SHARDS shards raise an error rather than fill the driver.
    """
    rows = reference.select(F.col(id_col).cast("long"), F.col(name_col).cast("string")).where(f"`{id_col}` is not null and `{name_col}` is not null").limit(SHARD * MOST_SHARDS + 1).collect()
    if len(rows) > SHARD * MOST_SHARDS:
        raise ValueError(f"a reference list may have at most {SHARD * MOST_SHARDS} entries")
    entries = sorted((form, r[0]) for r in rows if (form := name_form(r[1])))
    most_words = max((len(_WORDS.findall(r[1])) for r in rows), default=1)
    return [entries[i : i + SHARD] for i in range(0, len(entries), SHARD)] or [[]], most_words


def map_titles(titles: DataFrame, reference: DataFrame, id_col: str = "brand_id", name_col: str = "brand") -> DataFrame:
    """``rid, entry, distance, ties`` of ``rid, title``: each title's entry of the reference list, 0 for none.

    ``titles`` should come in its one form.  Every run of as many words as the
    longest name has, and one more, as a name may be parted, is searched,
    wherever it stands; mentions in passing (of compatible or replaced
    articles) are left out.  Null and empty titles give 0 with a null
    distance.  ``ties`` counts the entries equally near.  An empty reference
    list maps all to 0.  Repeated rows are kept.
    """
    shards, most_words = reference_shards(reference, id_col, name_col)
    ordinary = ordinary_words(titles)
    sc = titles.sparkSession.sparkContext

    def searching(shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _search(shard, most_words + 1, ordinary)
            for batch in batches:
                queries = [search.windows(t) for t in batch.column(1).to_pylist()]
                search.learn(queries)
                found = [search.best(q) or (None, 0, 0) for q in queries]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())],
                    names=["rid", "entry", "distance", "ties"],
                )

        return run

    schema = "rid long, entry long, distance int, ties int"
    rows = spread(titles.select(F.col("rid").cast("long").alias("rid"), "title"))
    parts = [rows.mapInArrow(searching(sc.broadcast(s)), schema) for s in shards]
    if len(parts) == 1:
        return parts[0]
    return nearest(reduce(DataFrame.unionByName, parts))


def nearest(found: DataFrame) -> DataFrame:
    """One row per rid: the nearest entry, the smaller of equally near ones, none only where no row has one."""
    rank = F.struct(F.coalesce("distance", F.lit(2**31 - 1)).alias("d"), F.col("entry"), F.col("distance"), F.col("ties"))
    return found.groupBy("rid").agg(F.min(rank).alias("m")).select("rid", "m.entry", "m.distance", "m.ties")
