"""Text that looks the same brought to one form.

Compatibility forms (full-width and joined letters), separate accents, odd
blanks and hyphens and ignorable characters follow rules.  Letters of another
alphabet inside a word are found by a search: every letter of the word
opens all the alternatives it looks like, and the path through this lattice with
the best score under script-consistent character bigrams gives the word.  The
bigrams are counted over all texts of the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftline.functions.textforms import LOOK_ALIKES
from weftline.session import spread

WORD = re.compile(r"[^\W_]+")
#: Cost, in natural logarithms, of two letters of different alphabets side by side.
SWITCH = 12.0
#: Cost of reading a letter as one it only looks like.
CHANGE = 1.0

#: What each letter may be read as: look-alikes of the table, both ways.
READINGS: dict[str, str] = dict(LOOK_ALIKES)
for _ch, _latin in LOOK_ALIKES.items():
    if 0x370 <= ord(_ch) < 0x530:  # Latin letters are strays only in Greek and Cyrillic words
        for _to in _latin:
            if _to.isalpha():
                READINGS[_to] = READINGS.get(_to, "") + _ch


def script(ch: str) -> str:
    """L, C, G for Latin, Cyrillic and Greek letters, O for other letters, empty for the rest."""
    if ch.isascii():
        return "L" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "L"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    return "C" if 0x400 <= code < 0x530 else "O"


# Marks that stand for themselves: copyright and trade marks, spacing accents.
KEPT = frozenset("©®™℠℗¨¯´¸")


class _Kinds(dict):
    """Code point to (is it in place of an ordinary character, what replaces it)."""

    def __missing__(self, code: int) -> tuple[bool, str]:
        ch = chr(code)
        kind, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        tag = form.split(">")[0].lstrip("<") if form.startswith("<") else ""
        if kind == "Cf" or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F:
            out = (True, "")
        elif kind in ("Zs", "Zl", "Zp") and ch != " ":
            out = (True, " ")
        elif 0x2010 <= code <= 0x2012 or code in (0x2212, 0xFE58, 0xFE63):
            out = (True, "-")
        elif kind == "Mn" and 0x300 <= code < 0x370:
            out = (True, ch)  # composed with its letter afterwards
        elif tag in ("wide", "narrow", "font", "initial", "medial", "final", "isolated", "square") or tag == "compat" and (kind == "Nl" or "LIGATURE" in unicodedata.name(ch, "")):
            out = (True, unicodedata.normalize("NFKC", ch))
        elif tag in ("compat", "fraction", "circle") and ch not in KEPT:
            out = (False, unicodedata.normalize("NFKC", ch).replace("\u2044", "/"))
        else:
            out = (False, ch)
        self[code] = out
        return out


KINDS = _Kinds()


def plain(text: str) -> tuple[str, bool]:
    """The text by the rules alone, and whether any character was in place of an ordinary one."""
    hit, out = False, []
    for ch in text:
        odd, to = KINDS[ord(ch)]
        hit = hit or odd
        out.append(to)
    joined = "".join(out)
    return (unicodedata.normalize("NFC", joined) if not joined.isascii() else joined), hit


class Bigrams:
    """Script-consistent character bigram scores; unseen pairs get the add-half estimate."""

    def __init__(self, counts: dict[str, int]):
        self.pair = counts
        self.first: dict[str, int] = {}
        for k, n in counts.items():
            self.first[k[0]] = self.first.get(k[0], 0) + n
        self.size = max(40, len({k[-1] for k in counts}))
        self.memo: dict[str, float] = {}

    def __call__(self, a: str, b: str) -> float:
        key = a + b
        if key not in self.memo:
            self.memo[key] = math.log((self.pair.get(key, 0) + 0.5) / (self.first.get(a, 0) + 0.5 * self.size))
        return self.memo[key]


def best_word(word: str, score: Bigrams) -> str:
    """Best path through the look-alike lattice of a word of mixed alphabets.

    States are readings of a letter.  Digits belong to every alphabet; the
    alphabet carried along is that of the last letter read.
    """
    layer = {("", "^"): (0.0, "")}  # (alphabet so far, last letter): (cost, reading)
    for ch in word:
        options = [(ch, 0.0)]
        options.extend((other, CHANGE) for other in READINGS.get(ch, ""))
        nxt: dict = {}
        for (alphabet, last), (cost, read) in layer.items():
            for to, extra in options:
                s = script(to)
                c = cost + extra - score(last.lower(), to.lower())
                if s and alphabet and s != alphabet:
                    c += SWITCH
                state = (s or alphabet, to)
                if state not in nxt or c < nxt[state][0]:
                    nxt[state] = (c, read + to)
        layer = nxt
    return min(layer.values())[1]


def one_form(text: str | None, score: Bigrams, memo: dict | None = None) -> tuple[str, bool]:
    """The text's one form, and whether it held a character in place of the ordinary one.

    Null and empty texts give an empty form.  Words wholly in another alphabet
    stay as they are, as do composed accents and trade marks.
    """
    if not text:
        return "", False
    if text.isascii():
        return text, False
    out, hit = plain(text)
    if out.isascii():
        return out, hit

    def fix(m: re.Match) -> str:
        nonlocal hit
        w = m[0]
        if w.isascii():
            return w
        scripts = {s for s in map(script, w) if s}
        if "L" not in scripts or len(scripts) == 1:
            return w
        if memo is None:
            new = best_word(w, score)
        else:
            if w not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[w] = best_word(w, score)
            new = memo[w]
        hit = hit or new != w and any(script(c) == "L" for c in new)
        return new

    return WORD.sub(fix, out), hit


def count_bigrams(texts: DataFrame, column: str) -> dict[str, int]:
    """Bigram counts over all texts, from words of one alphabet; ``^`` stands before a word.

    Counted per Arrow batch before the exchange.  Only pairs of letters and
    digits of three alphabets are counted, so at most some hundred thousand
    counts reach the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Counter(WORD.findall("\n".join(t for t in batch.column(0).to_pylist() if t)))
            n: dict[str, int] = {}
            for w, k in words.items():
                kinds = {s for s in map(script, w) if s}
                if len(kinds) != 1 or "O" in kinds:
                    continue
                low = "^" + plain(w)[0].lower()
                for a, b in zip(low, low[1:], strict=False):
                    if (a == "^" or ord(a) < 0x530) and ord(b) < 0x530:
                        n[a + b] = n.get(a + b, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pair", "n"])

    rows = texts.select(column).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r["pair"]: r["n"] for r in rows}


def record_texts(records: DataFrame) -> DataFrame:
    """``rid, title, features`` with one row per distinct listing row."""
    return records.select(F.col("rid").cast("long").alias("rid"), "title", F.map_entries("features").alias("features"))


def _all_text(records: DataFrame) -> DataFrame:
    entries = F.transform(F.coalesce(F.map_entries("features"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return records.select(F.concat_ws(" ", "title", F.array_join(entries, " ")).alias("text"))


def fit(records: DataFrame) -> Bigrams:
    """Bigrams of all titles and features."""
    return Bigrams(count_bigrams(_all_text(records), "text"))


FORMS = "rid long, title string, features array<struct<key:string,value:string>>, title_odd boolean, features_odd boolean"


def _formed(texts: pa.Array, score: Bigrams, memo: dict) -> tuple[pa.Array, np.ndarray]:
    """Texts in their one form, and which of them held a character in place of the ordinary one; ASCII texts stay untouched."""
    texts, odd = texts.cast(pa.string()), np.zeros(len(texts), dtype=bool)
    foreign = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    at = np.flatnonzero(foreign.to_numpy(zero_copy_only=False))
    if not len(at):
        return texts, odd
    done = [one_form(t, score, memo) for t in texts.take(pa.array(at)).to_pylist()]
    odd[at] = [hit for _, hit in done]
    return pc.replace_with_mask(texts, foreign, pa.array([form for form, _ in done], pa.string())), odd


def to_one_form(records: DataFrame, score: Bigrams | None = None) -> DataFrame:
    """Records ``rid, title, features`` with every text in its one form, and flags.

    ``features`` comes back as an array of entries, since two names may fall
    together in their one form.  A null title or map stays null and is
    unflagged.  Repeated rows are kept.
    """
    score = score or fit(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            titles, title_odd = _formed(batch.column(1), score, memo)
            lists = batch.column(2)
            entries = lists.flatten()
            keys, odd_key = _formed(pc.struct_field(entries, [0]), score, memo)
            values, odd_value = _formed(pc.struct_field(entries, [1]), score, memo)
            features_odd = np.zeros(len(lists), dtype=bool)
            features_odd[pc.list_parent_indices(lists).to_numpy()[odd_key | odd_value]] = True
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            features = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([keys, values], names=["key", "value"]), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), titles, features, pa.array(title_odd), pa.array(features_odd)], names=["rid", "title", "features", "title_odd", "features_odd"])

    return spread(record_texts(records)).mapInArrow(run, FORMS)


def odd_texts(forms: DataFrame) -> DataFrame:
    """``rid, field`` of the texts that held a character in place of the ordinary one."""
    fields = F.array(F.when(F.col("title_odd"), "title"), F.when(F.col("features_odd"), "features"))
    return forms.filter("title_odd or features_odd").select("rid", F.explode(F.array_compact(fields)).alias("field")).distinct()
