"""Scores of all pairs of many records at once, as grids over the records of a few classes.

A score depends on a pair's distinct texts alone, and these are few beside the
pairs.  So a task holds the records of two groups of a block, codes their
texts, names, values and words, works out what is distinct, and looks the
rest up.  No pair is shuffled or written before it is scored, so disk holds
records, not pairs; what a task returns is named pairs, connected records or
clusters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.config import DedupConfig
from weftline.functions.strings import mixed_tokens
from weftline.session import durable
from weftline.sources.records import ordinals

#: Cells of a table that is worked out once for a task, at most, and those of a grid.
TABLE, CELLS = 2_000_000, 250_000
BLANK = re.compile(r"[ \t\n\x0b\f\r]+")
DIGIT = re.compile(r"\d")


class Codes(dict):
    """Numbers of values in the order in which they are first asked for."""

    def __missing__(self, x):
        self[x] = len(self)
        return self[x]


class Lists:
    """Lists of codes one after the other."""

    def __init__(self, lists: list[list[int]]):
        self.size = np.array([len(x) for x in lists], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = np.array([c for x in lists for c in x], dtype=np.int64)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``at`` and code of all entries of these lists."""
        n = self.size[at]
        row = np.repeat(np.arange(len(at)), n)
        return row, self.codes[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[:-1][at], n)]


def counts(rows: np.ndarray, codes: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``columns`` occurs in each row."""
    at = np.searchsorted(columns, codes)
    at[at == len(columns)] = 0
    keep = columns[at] == codes if len(columns) else np.zeros(len(codes), dtype=bool)
    out = np.zeros((n, len(columns)), dtype=np.float32)
    np.add.at(out, (rows[keep], at[keep]), 1)
    return out


def shared(lists: Lists, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the codes that occur on both sides."""
    (ra, ca), (rb, cb) = lists.of(a), lists.of(b)
    columns = np.intersect1d(ca, cb)
    return counts(ra, ca, len(a), columns), counts(rb, cb, len(b), columns)


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of the texts of ``a`` and ``b`` at the same places."""
    out = np.zeros(len(a), dtype=np.int64)
    order = np.array(sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k]))), dtype=np.int64)
    at = 0
    while at < len(order):
        m = max(len(a[k]) for k in order[at : at + 512])
        w = max(1, max(len(b[k]) for k in order[at : at + 512]))
        part = order[at : at + 512]
        x = np.full((len(part), m), -1, dtype=np.int32)
        y = np.full((len(part), w), -2, dtype=np.int32)
        for p, k in enumerate(part):
            x[p, : len(a[k])] = np.frombuffer(a[k].encode("utf-32-le", "surrogatepass"), dtype=np.int32)
            y[p, : len(b[k])] = np.frombuffer(b[k].encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        la, lb = np.array([len(a[k]) for k in part]), np.array([len(b[k]) for k in part])
        step = np.arange(w + 1, dtype=np.int32)
        row = np.tile(step, (len(part), 1))
        found = np.where(la == 0, lb, 0)
        for i in range(m):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (y != x[:, i : i + 1]), out=new[:, 1:])
            row = np.minimum.accumulate(new - step, axis=1) + step
            end = np.flatnonzero(la == i + 1)
            found[end] = row[end, lb[end]]
        out[part] = found
        at += len(part)
    return out


def six(x: np.ndarray) -> np.ndarray:
    """Rounded half up to six digits, as the decimal text of each number says."""
    y = x * 1e6
    out = np.floor(np.abs(y) + 0.5) * np.sign(y) / 1e6
    near = np.abs(np.abs(y - np.trunc(y)) - 0.5) < 1e-6 * np.maximum(1, np.abs(x))
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values])[at.reshape(-1)]
    return out + 0.0


class Unit:
    """The records of a task, coded: pieces of classes in order, records of a piece by rid."""

    def __init__(self, rows: list[tuple], contents: list[tuple]):
        titles, schemas, self.values, words, tokens, grams = Codes(), Codes(), Codes(), Codes(), Codes(), Codes()
        pieces = Codes()
        of_piece = [pieces[rep, chunk] for rep, chunk, _, _ in rows]
        kinds = [(titles[title], schemas[keys], [self.values[v] for v in values]) for title, keys, values, _ in contents]
        told = [[[words[w] for w in e] for e in mixed] for *_, mixed in contents]
        self.pieces, self.of_piece = pieces, np.array(of_piece, dtype=np.int64)
        self.rid, self.content = (np.array([r[c] for r in rows], dtype=np.int64) for c in (2, 3))
        self.first = np.searchsorted(self.of_piece, np.arange(len(pieces) + 1))
        self.title, self.schema = (np.array([k[c] for k in kinds], dtype=np.int64) for c in (0, 1))
        self.titles, self.schemas, self.words = list(titles), list(schemas), list(words)
        self.entries = np.array([len(k[2]) for k in kinds], dtype=np.int64)
        self.told = told
        self.word_lists = Lists([[w for e in x for w in e] for x in told])
        self.token_lists = Lists([[tokens[w] for w in BLANK.split(t) if w] for t in self.titles])
        self.norm = np.array([np.sum(np.unique(self.token_lists.of(np.array([t]))[1], return_counts=True)[1] ** 2) for t in range(len(self.titles))], dtype=np.float64)
        self.columns: list[list[np.ndarray]] = []
        self.place = np.zeros(len(kinds), dtype=np.int64)
        for s, keys in enumerate(self.schemas):
            own = np.flatnonzero(self.schema == s)
            self.place[own] = np.arange(len(own))
            self.columns.append([np.array([kinds[c][2][p] for c in own], dtype=np.int64) for p in range(len(keys))])
        self.gram_lists = Lists([[grams[g] for g in qgrams(v)] for v in self.values])
        letters, digits = Codes(), Codes()
        self.letters = np.array([letters[DIGIT.sub("", w)] for w in self.words], dtype=np.int64)
        self.digits = np.array([digits["".join(DIGIT.findall(w))] for w in self.words], dtype=np.int64)
        self.letter_texts = list(letters)
        self.letter_lists = Lists([sorted({int(self.letters[w]) for e in x for w in e}) for x in told])
        self.length = np.array([len(w) for w in self.words], dtype=np.float64)
        row, code = self.word_lists.of(np.arange(len(kinds)))
        self.least, self.most = np.full(len(kinds), 1 << 60), np.full(len(kinds), -1)
        np.minimum.at(self.least, row, self.digits[code])
        np.maximum.at(self.most, row, self.digits[code])
        self.kept: dict = {}
        self.matched: dict = {}

    # distinct texts

    def _table(self, name, a: np.ndarray, b: np.ndarray, work: Callable) -> Callable:
        """``work`` of all distinct ``a`` against ``b`` once for the task, if these are few; else of what a grid asks for."""
        if name not in self.kept:
            x, y = np.unique(a), np.unique(b)
            self.kept[name] = (x, y, work(x, y)) if 0 < len(x) * len(y) <= TABLE else None

        def look(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            if self.kept[name]:
                x, y, t = self.kept[name]
                return t[np.ix_(np.searchsorted(x, p), np.searchsorted(y, q))]
            x, at = np.unique(p, return_inverse=True)
            y, to = np.unique(q, return_inverse=True)
            return work(x, y)[np.ix_(at.reshape(-1), to.reshape(-1))]

        return look

    def _gram_similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = shared(self.gram_lists, a, b)
        same = x @ np.minimum(y, 1).T + np.minimum(x, 1) @ y.T
        return same.astype(np.float64) / (self.gram_lists.size[a][:, None] + self.gram_lists.size[b][None, :])

    def _edit_shares(self, texts: list[str], a: np.ndarray, b: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
        """Levenshtein distance over the longer length, where needed."""
        out = np.zeros((len(a), len(b)))
        wanted = a[:, None] != b[None, :]
        p, q = np.nonzero(wanted if need is None else wanted & need)
        if len(p):
            u, at = np.unique(np.minimum(a[p], b[q]) * len(texts) + np.maximum(a[p], b[q]), return_inverse=True)
            x, y = [texts[k // len(texts)] for k in u], [texts[k % len(texts)] for k in u]
            out[p, q] = (edits(x, y) / np.array([max(len(s), len(t)) for s, t in zip(x, y, strict=True)]))[at.reshape(-1)]
        return out

    # grids of contents

    def cosine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (x, at), (y, to) = (np.unique(self.title[c], return_inverse=True) for c in (a, b))
        u, v = shared(self.token_lists, x, y)
        norm = np.sqrt(self.norm[x][:, None] * self.norm[y][None, :])
        return np.divide((u @ v.T).astype(np.float64), norm, out=np.zeros(norm.shape), where=norm > 0)[np.ix_(at.reshape(-1), to.reshape(-1))]

    def equal_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = shared(self.word_lists, a, b)
        return (x @ y.T).astype(np.float64)

    def _near(self, a: np.ndarray, b: np.ndarray) -> tuple:
        """Counts of the words of either side, these words, and which are near by their letters."""
        (ra, ca), (rb, cb) = self.word_lists.of(a), self.word_lists.of(b)
        x, y = np.unique(ca), np.unique(cb)
        return counts(ra, ca, len(a), x), counts(rb, cb, len(b), y), x, y, self._close(self.letters[x], self.letters[y])

    def _close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._table("letters", self.letters, self.letters, lambda p, q: self._edit_shares(self.letter_texts, p, q) < 0.5)(a, b)

    def clash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (ra, ca), (rb, cb) = self.letter_lists.of(a), self.letter_lists.of(b)
        u, v = np.unique(ca), np.unique(cb)
        x, y, close = counts(ra, ca, len(a), u), counts(rb, cb, len(b), v), self._close(u, v)
        differ = np.minimum(self.least[a][:, None], self.least[b][None, :]) != np.maximum(self.most[a][:, None], self.most[b][None, :])
        full = (self.word_lists.size[a] > 0)[:, None] & (self.word_lists.size[b] > 0)[None, :]
        return ((np.minimum(x, 1) @ close.astype(np.float32)) @ np.minimum(y, 1).T > 0) & differ & full

    def word_edits(self, near: tuple) -> np.ndarray:
        x, y, u, v, close = near
        like = close & (self.digits[u][:, None] == self.digits[v][None, :])
        weight = (self.length[u][:, None] + self.length[v][None, :]) * like
        gain = (1 - self._edit_shares(self.words, u, v, like)) * weight
        x, y = x.astype(np.float64), y.astype(np.float64)
        total, won = x @ weight @ y.T, x @ gain @ y.T
        return np.divide(won, total, out=np.zeros(total.shape), where=total > 0)

    def titles_alike(self, a: np.ndarray, b: np.ndarray, c: DedupConfig) -> np.ndarray:
        cos = self.cosine(a, b)
        far = ~(cos > c.alpha)
        need = far & ~self.clash(a, b)
        out = np.where(far, -1.0, 1.0)
        if need.any():
            (x, at), (y, to) = (np.unique(self.title[k], return_inverse=True) for k in (a, b))
            at, to = at.reshape(-1), to.reshape(-1)
            wanted = np.zeros((len(x), len(y)), dtype=bool)
            p, q = np.nonzero(need)
            wanted[at[p], to[q]] = True
            share = self._edit_shares(self.titles, x, y, wanted)[np.ix_(at, to)]
            s = c.beta * cos + (1 - c.beta) * (1 - share)
            words = self.word_edits(self._near(a, b))
            out[need] = np.where(words > 0, c.delta * words + (1 - c.delta) * s, s)[need]
        return out

    def _matches(self, s: int, r: int, gamma: float) -> tuple[list, list, list]:
        """For each name of schema ``r`` the first of ``s`` above gamma, and the places that no match took."""
        if (s, r) not in self.matched:
            left, right = ([qgrams(k) for k in self.schemas[x]] for x in (s, r))
            found = []
            for j, g in enumerate(right):
                for i, h in enumerate(left):
                    w = (sum(x in g for x in h) + sum(x in h for x in g)) / (len(g) + len(h))
                    if w > gamma:
                        found.append((i, j, w))
                        break
            names = {self.schemas[s][i] for i, _, _ in found}, {self.schemas[r][j] for _, j, _ in found}
            rest = [[p for p, k in enumerate(self.schemas[x]) if k not in taken] for x, taken in zip((s, r), names, strict=True)]
            self.matched[s, r] = found, *rest
        return self.matched[s, r]

    def matches(self, a: np.ndarray, b: np.ndarray, gamma: float, rest: bool = True) -> dict[str, np.ndarray]:
        """``m, avg, left_i, left_j`` and the overlap of the ``rest`` of left ``a`` and right ``b``."""
        out = {k: np.zeros((len(a), len(b))) for k in ("m", "avg", "left_i", "left_j", "rest")}
        for s in np.unique(self.schema[a]):
            for r in np.unique(self.schema[b]):
                p, q = np.flatnonzero(self.schema[a] == s), np.flatnonzero(self.schema[b] == r)
                cell = np.ix_(p, q) if (len(p), len(q)) != (len(a), len(b)) else (slice(None), slice(None))
                found, left, right = self._matches(s, r, gamma)
                gain, total = np.zeros((len(p), len(q))), 0.0
                for i, j, w in found:
                    u, v = self.columns[s][i], self.columns[r][j]
                    alike = self._table(("grams", s, i, r, j), u, v, self._gram_similarity)(u[self.place[a[p]]], v[self.place[b[q]]])
                    gain += w * alike
                    total += w
                out["m"][cell], out["left_i"][cell], out["left_j"][cell] = len(found), len(left), len(right)
                if total > 0:
                    out["avg"][cell] = gain / total
                if rest and left and right:
                    x, y = (Lists([[w for e in places for w in self.told[c][e]] for c in side]) for side, places in ((a[p], left), (b[q], right)))
                    both = Lists.__new__(Lists)
                    both.size, both.codes = np.concatenate([x.size, y.size]), np.concatenate([x.codes, y.codes])
                    both.start = np.concatenate([[0], np.cumsum(both.size)])
                    u, v = shared(both, np.arange(len(p)), len(p) + np.arange(len(q)))
                    full = (x.size > 0)[:, None] & (y.size > 0)[None, :]
                    out["rest"][cell] = np.divide((u @ v.T).astype(np.float64), np.broadcast_to(x.size[:, None], full.shape), out=np.zeros(full.shape), where=full)
        return out

    def distance(self, a: np.ndarray, b: np.ndarray, c: DedupConfig, t: np.ndarray) -> np.ndarray:
        """Distances of left ``a`` and right ``b``; NaN where a side has no attribute."""
        k = self.matches(a, b, c.gamma)
        few = np.minimum(self.entries[a][:, None], self.entries[b][None, :]).astype(np.float64)
        share = np.divide(k["m"], few, out=np.full(few.shape, np.nan), where=few > 0)
        theta = (1 - c.mu) * share
        without = share * k["avg"] + (1 - share) * k["rest"]
        blended = theta * k["avg"] + (1 - c.mu - theta) * k["rest"] + c.mu * t
        return 1 - np.where(t == -1, without, blended)


def qgrams(text: str, q: int = 3) -> list[str]:
    return [text[i : i + q] for i in range(len(text) - q + 1)] if len(text) >= q else [text]


#: A score: columns of a grid with ``a`` left, and of the same grid with ``b`` left.
Score = Callable[[Unit, np.ndarray, np.ndarray, DedupConfig], tuple[list[np.ndarray], list[np.ndarray]]]


def _both(columns: Callable) -> Score:
    """A score that is the same in either order."""

    def score(u, a, b, c):
        out = columns(u, a, b, c)
        return out, out

    return score


def _turned(columns: Callable) -> Score:
    """A score that is worked out in each order."""

    def score(u, a, b, c):
        return columns(u, a, b, c), [x.T for x in columns(u, b, a, c)]

    return score


def _overlap(u: Unit, a: np.ndarray, b: np.ndarray, c: DedupConfig):
    same, n, m = u.equal_words(a, b), u.word_lists.size[a][:, None], u.word_lists.size[b][None, :]
    return [same / np.maximum(n, 1)], [same / np.maximum(m, 1)]


def _distance(u: Unit, a: np.ndarray, b: np.ndarray, c: DedupConfig):
    t = u.titles_alike(a, b, c)
    pairs = [(s, r) for s in np.unique(u.schema[a]) for r in np.unique(u.schema[b])]
    turned = all([(j, i, w) for i, j, w in u._matches(r, s, c.gamma)[0]] == u._matches(s, r, c.gamma)[0] and not u._matches(s, r, c.gamma)[1] + u._matches(s, r, c.gamma)[2] for s, r in pairs)
    one = [u.distance(a, b, c, t)]
    return one, one if turned else [u.distance(b, a, c, t.T).T]


def _greedy(u, a, b, c):
    k = u.matches(a, b, c.gamma, rest=False)
    return [k["m"], k["avg"]]


def _leftover(u, a, b, c):
    k = u.matches(a, b, c.gamma)
    return [k["left_i"], k["left_j"], k["rest"]]


SCORES: dict[str, Score] = {
    "min_features": _both(lambda u, a, b, c: [np.minimum(u.entries[a][:, None], u.entries[b][None, :])]),
    "mw_overlap": _overlap,
    "mw_levenshtein": _both(lambda u, a, b, c: [u.word_edits(u._near(a, b))]),
    "title_cosine": _both(lambda u, a, b, c: [u.cosine(a, b)]),
    "title_mw_similarity": _both(lambda u, a, b, c: [u.titles_alike(a, b, c)]),
    "greedy_key_match": _turned(_greedy),
    "leftover_model_words": _turned(_leftover),
    "pair_distance": _distance,
}


def grids(unit: Unit, pairs: list[tuple], name: str, config: DedupConfig, rounded: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows of a piece, rows of pieces that it meets, which of their cells count, and the columns of the score, the smaller rid always left."""
    meets: dict[int, list[int]] = {}
    for left, right in pairs:
        p, q = sorted((unit.pieces[left], unit.pieces[right]))
        meets.setdefault(p, []).append(q)
    for p, others in sorted(meets.items()):
        rows = np.arange(unit.first[p], unit.first[p + 1])
        some: list[np.ndarray] = []
        for q in sorted(others):
            if some and len(rows) * (sum(map(len, some)) + unit.first[q + 1] - unit.first[q]) > CELLS:
                yield _grid(unit, p, rows, np.concatenate(some), name, config, rounded)
                some = []
            some.append(np.arange(unit.first[q], unit.first[q + 1]))
        yield _grid(unit, p, rows, np.concatenate(some), name, config, rounded)


def _grid(unit: Unit, p: int, rows: np.ndarray, to: np.ndarray, name: str, config: DedupConfig, rounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    (a, at), (b, back) = (np.unique(unit.content[x], return_inverse=True) for x in (rows, to))
    fore, hind = SCORES[name](unit, a, b, config)
    ahead = unit.rid[rows][:, None] < unit.rid[to][None, :]
    cell = np.ix_(at.reshape(-1), back.reshape(-1))
    columns = []
    for x, y in zip(fore, hind, strict=True):
        same = x is y
        if rounded and x.dtype.kind == "f":
            x = six(x)
            y = x if same else six(y)
        columns.append(x[cell] if same else np.where(ahead, x[cell], y[cell]))
    # a piece meets itself in the half where the smaller rid is on the left
    return rows, to, ahead | (unit.of_piece[to] != p)[None, :], columns


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Unit, list[tuple]]]:
    """The records and the pairs of pieces of each unit, from rows in its order, records first."""
    now, rows, contents, pairs = None, [], Codes(), []
    told, texts = [], {}
    one = lambda x: texts.setdefault(x, x)
    for batch in batches:
        for at, kind, rep, chunk, rid, rep_j, chunk_j, title, keys, values, mixed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != now:
                if pairs:
                    yield Unit(rows, [(*k, m) for k, m in zip(contents, told, strict=True)]), pairs
                now, rows, contents, pairs, told = at, [], Codes(), [], []
                texts.clear()
            if kind == 0:
                k = contents[one(title), one(tuple(map(one, keys))), tuple(map(one, values))]
                if k == len(told):
                    told.append([[one(w) for w in e] for e in mixed])
                rows.append((rep, chunk, rid, k))
            else:
                pairs.append(((rep, chunk), (rep_j, chunk_j)))
    if pairs:
        yield Unit(rows, [(*k, m) for k, m in zip(contents, told, strict=True)]), pairs


def near_labels(unit: Unit, found: Iterator, epsilon: float) -> np.ndarray:
    """Smallest row (in order of rid) that each row is connected with, -1 for a row without a near pair."""
    order = np.argsort(np.argsort(unit.rid))
    label = order.copy()
    at = np.argsort(order)
    kept, seen = [], np.zeros(len(label), dtype=bool)
    for rows, to, counted, (dist,) in found:
        near = counted & (dist < epsilon)
        seen[rows[near.any(axis=1)]] = seen[to[near.any(axis=0)]] = True
        kept.append((rows, to, near.shape, np.packbits(near)))
    changed, most = True, len(label)
    while changed:
        changed = False
        for rows, to, shape, bits in kept:
            near = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool)
            a = np.minimum(label[rows], np.where(near, label[to][None, :], most).min(axis=1))
            b = np.minimum(label[to], np.where(near, a[:, None], most).min(axis=0))
            changed = changed or bool((a < label[rows]).any() or (b < label[to]).any())
            label[rows] = np.minimum(label[rows], a)
            label[to] = np.minimum(label[to], b)
        label = np.minimum(label, label[at[label]])
    return np.where(seen, at[label], -1)


def linked(unit: Unit, found: Iterator, epsilon: float, rounded: bool) -> np.ndarray:
    """For each row the row of the smallest rid of its cluster by complete linkage of the pairs nearer than epsilon.

    Clusters that are each other's nearest merge, along chains of nearest
    neighbours; ties go to the smaller rids.  Since a merged cluster is never
    nearer than its parts were, the order of such merges doesn't matter.
    """
    far, kind = (np.iinfo(np.int32).max, np.int32) if rounded else (np.inf, np.float64)
    meets: list[dict[int, np.ndarray]] = [{} for _ in range(len(unit.first) - 1)]
    for rows, to, counted, (dist,) in found:
        near = counted & (dist < epsilon)
        cells = np.where(near, np.rint(dist * 1e6) if rounded else dist, far).astype(kind)
        p = int(unit.of_piece[rows[0]])
        starts = np.flatnonzero(np.diff(unit.of_piece[to], prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(to)], strict=True):
            q = int(unit.of_piece[to[s]])
            own = np.ascontiguousarray(cells[:, s:e])
            if p == q:
                own = np.minimum(own, own.T)
            meets[p][q] = own
            if p != q:
                meets[q][p] = own.T
    first, piece, rid = unit.first, unit.of_piece.tolist(), unit.rid.tolist()
    inner = [x - int(first[piece[x]]) for x in range(len(rid))]

    def nearest(x: int) -> int:
        best, at = (far, 0), -1
        for q, m in meets[piece[x]].items():
            row = m[inner[x]]
            k = int(row.argmin())
            d = row[k]
            if d < far and (d, rid[y := int(first[q]) + k]) < best or d < far and at < 0:
                best, at = (d, rid[y]), y
        return at

    def merge(a: int, b: int) -> None:
        pa_, pb_, i, j = piece[a], piece[b], inner[a], inner[b]
        of_b = {q: m[j].copy() for q, m in meets[pb_].items()}
        for q, m in meets[pa_].items():
            new = np.maximum(m[i], of_b[q]) if q in of_b else far
            m[i] = new
            if q == pa_:
                m[i, i] = far
                m[:, i] = m[i]
        for q, m in meets[pb_].items():
            m[j] = far
            if q == pb_:
                m[:, j] = far

    into = list(range(len(rid)))
    gone = [False] * len(rid)
    for x in range(len(rid)):
        chain = [] if gone[x] else [x]
        while chain:
            y = nearest(chain[-1])
            if y < 0:
                chain.pop()
            elif len(chain) > 1 and y == chain[-2]:
                a, b = sorted((chain.pop(), chain.pop()), key=rid.__getitem__)
                merge(a, b)
                into[b], gone[b] = a, True
                if not chain:
                    chain.append(a)
            else:
                chain.append(y)
    out = np.array(into)
    while (out[out] != out).any():
        out = out[out]
    return out


# tasks

#: Records of a piece of a class, records of a group, and cells of a block whose pairs one task may hold, at most.
PIECE, GROUP, WHOLE = 512, 16_384, 64_000_000
#: Rows that a task returns at once, about, and its tasks, at most.
ROWS, MOST_TASKS = 500_000, 2000
#: Columns of the scores.
COLUMNS = {
    "min_features": "min_features int",
    "mw_overlap": "overlap double",
    "mw_levenshtein": "similarity double",
    "title_cosine": "cosine double",
    "title_mw_similarity": "similarity double",
    "greedy_key_match": "m int, avg_sim double",
    "leftover_model_words": "left_i int, left_j int, overlap double",
    "pair_distance": "dist double",
}


class Layout:
    """Records and pairs of pieces of classes dealt to tasks: ``rows`` by unit; ``large``, blocks of more than ``most`` cells, which are left out.

    ``classes`` has ``rid, rep`` and perhaps ``block``, ``near`` has ``rep_i,
    rep_j``, ``fields`` is as of ``score.fields``.  The records of a block are
    in groups of about ``group`` records, and a unit is two groups; with
    ``most`` a block is one group.
    """

    def __init__(self, classes: DataFrame, near: DataFrame, fields: DataFrame, group: int = GROUP, most: int | None = None):
        block = F.col("block") if "block" in classes.columns else F.lit("")
        place = F.row_number().over(Window.partitionBy("rep").orderBy("rid"))
        each = classes.select("rid", "rep", block.alias("block")).withColumn("chunk", F.floor((place - 1) / PIECE).cast("int"))
        each = durable(each)
        sizes = each.groupBy(F.col("block").alias("of")).agg(F.lit(1).cast("long").alias("groups") if most else F.ceil(F.count("*") / group).alias("groups"))
        pieces = each.groupBy("block", "rep", "chunk").agg(F.count("*").alias("n")).join(sizes, F.col("block").eqNullSafe(F.col("of"))).drop("of")
        pieces = durable(pieces.withColumn("g", F.expr("pmod(xxhash64(rep, chunk), groups)")))
        side = lambda s: pieces.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "rep", "chunk", "n", "g"))).hint("merge")
        same = pieces.select(F.col("rep").alias("rep_i")).distinct().withColumn("rep_j", F.col("rep_i"))
        met = near.select("rep_i", "rep_j").unionByName(same).join(side("i"), "rep_i").join(side("j"), "rep_j").filter("rep_i <> rep_j or chunk_i <= chunk_j")
        links = durable(met.select(F.col("block_i").alias("block"), F.least("g_i", "g_j").alias("a"), F.greatest("g_i", "g_j").alias("b"), "rep_i", "chunk_i", "rep_j", "chunk_j", F.expr("n_i * n_j").alias("cells")))
        work = links.groupBy("block", "a", "b").agg(F.sum("cells").alias("cells"))
        self.large = durable(work.filter(F.col("cells") > most).select("block")) if most else None
        named = durable(_numbered(work.filter(F.col("cells") <= most) if most else work))
        self.tasks = max(1, min(MOST_TASKS, named.count()))
        numbers = named.select(F.col("block").alias("of"), F.col("a").alias("of_a"), F.col("b").alias("of_b"), "unit")
        at = lambda df: df.join(numbers, F.expr("block <=> of and a = of_a and b = of_b"))
        twice = pieces.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("block", "rep", "chunk", F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"))
        where = at(twice).select("unit", "rep", "chunk")
        kv = lambda e, c: F.transform("kv", lambda x: x[c]).alias(e)
        texts = fields.select("rid", "title", kv("keys", "key"), kv("values", "value"), F.transform("kv", lambda x: mixed_tokens(F.array(x["value"]))).alias("mixed"))
        none = lambda t: F.lit(None).cast(t)
        long = lambda c: F.col(c).cast("long").alias(c)
        records = each.join(where, ["rep", "chunk"]).join(texts.hint("merge"), "rid").select("unit", F.lit(0).alias("kind"), long("rep"), "chunk", long("rid"), none("long").alias("rep_j"), none("int").alias("chunk_j"), "title", "keys", "values", "mixed")
        pairs = at(links).select("unit", F.lit(1).alias("kind"), F.col("rep_i").cast("long").alias("rep"), F.col("chunk_i").alias("chunk"), none("long").alias("rid"), long("rep_j"), "chunk_j", none("string").alias("title"), *(none(t).alias(c) for c, t in (("keys", "array<string>"), ("values", "array<string>"), ("mixed", "array<array<string>>"))))
        self.rows = records.unionByName(pairs).repartitionById(self.tasks, (F.col("unit") % self.tasks).cast("int")).sortWithinPartitions("unit", "kind", "rep", "chunk", "rid")

    def pairs(self, name: str, config: DedupConfig, rounded: bool = True) -> DataFrame:
        """``rid_i, rid_j`` (i < j) and the columns of the score of all pairs of records."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, pairs in units(batches):
                for rows, to, counted, columns in grids(unit, pairs, name, config, rounded):
                    step = max(1, ROWS // len(to))
                    for k in range(0, len(rows), step):
                        part = slice(k, k + step)
                        take = counted[part]
                        p, q = unit.rid[rows[part]][:, None], unit.rid[to][None, :]
                        cells = [np.minimum(p, q)[take], np.maximum(p, q)[take], *(np.broadcast_to(c[part], take.shape)[take] for c in columns)]
                        out = [pa.array(c.astype(np.int32)) if t == "int" else pa.array(c, from_pandas=True) for c, t in zip(cells, types, strict=True)]
                        if len(out[0]):
                            yield pa.RecordBatch.from_arrays(out, names=names)

        schema = f"rid_i long, rid_j long, {COLUMNS[name]}"
        names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
        return self.rows.mapInArrow(run, schema)

    def normal(self, config: DedupConfig, rounded: bool = True) -> DataFrame:
        """One row: how many pairs lie strictly between 0 and 1."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, pairs in units(batches):
                n = sum(int((counted & (dist > 0) & (dist < 1)).sum()) for _, _, counted, (dist,) in grids(unit, pairs, "pair_distance", config, rounded))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["pairs"])

        return self.rows.mapInArrow(run, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))

    def near(self, config: DedupConfig, rounded: bool = True) -> DataFrame:
        """Edges ``u, v`` that connect the same records as all pairs nearer than epsilon."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, pairs in units(batches):
                label = near_labels(unit, grids(unit, pairs, "pair_distance", config, rounded), config.epsilon)
                own = np.flatnonzero((label >= 0) & (label != np.arange(len(label))))
                yield pa.RecordBatch.from_arrays([pa.array(unit.rid[label[own]]), pa.array(unit.rid[own])], names=["u", "v"])

        return self.rows.mapInArrow(run, "u long, v long")

    def clusters(self, config: DedupConfig, rounded: bool = True) -> DataFrame:
        """``rid, cluster_id`` by complete linkage; every unit has to be a whole block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, pairs in units(batches):
                into = linked(unit, grids(unit, pairs, "pair_distance", config, rounded), config.epsilon, rounded)
                yield pa.RecordBatch.from_arrays([pa.array(unit.rid), pa.array(unit.rid[into])], names=["rid", "cluster_id"])

        return self.rows.mapInArrow(run, "rid long, cluster_id long")


def _numbered(work: DataFrame) -> DataFrame:
    """``block, a, b, unit``: units numbered from 0, those of most cells first."""
    return ordinals(work.withColumn("less", -F.col("cells")), "less", "block", "a", "b", name="unit").select("block", "a", "b", "unit")
