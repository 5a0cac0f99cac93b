"""Languages of documents and of their blocks, by error-correcting output codes.

Each language has a codeword.  A binary classifier per bit, naive Bayes on
hashed n-grams of four bytes, says how likely the bit is set; decoding takes
the language whose codeword has the least logistic loss over all bits, so some
bits may be wrong.  Texts are scored where they lie, in one pass without an
exchange: n-grams of a whole Arrow batch are hashed in numpy and summed per
block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 15  # hashed n-grams: 2**BITS buckets
#: Documents in the training sample, about; at most twice as many are ever collected.
SAMPLE = 1500
#: Loss by which the nearest language must lead the next; else a text is ambiguous.
GAP = 6.0
#: Loss by which a block must be nearer to another language than to its document's main one: the odds, as a logarithm, against a
#: change of language within a document.  The same for every length; where less speaks for the other language the block is flagged.
FOREIGN_GAP = 100.0
#: Bytes scored at once.
WINDOW = 1 << 19

# Other codes and names of languages as they occur in labels.
OTHER_LABELS = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "deutsch": "de", "german": "de", "fra": "fr", "fre": "fr", "francais": "fr", "français": "fr", "french": "fr",
    "spa": "es", "espanol": "es", "español": "es", "spanish": "es", "castellano": "es", "ita": "it", "italiano": "it", "italian": "it", "nld": "nl", "dut": "nl", "nederlands": "nl", "dutch": "nl",
}

_END = rb"(?>\r\n|\n|\r|\xc2\x85|\xe2\x80[\xa8\xa9])"
_BLANK = rb"(?:[ \t\x0b\x0c]|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
SEPARATOR = re.compile(_END + rb"(?:" + _BLANK + rb"*" + _END + rb")+")
_EMPTY = re.compile(rb"(?:" + _BLANK + rb"|" + _END + rb")*")

_LOWER = np.full(256, 0x20, dtype=np.uint8)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


def blocks(text: bytes) -> list[tuple[int, int]]:
    """Start and end of each block; blocks lie between blank lines and hold more than blanks."""
    out, start = [], 0
    for m in SEPARATOR.finditer(text):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if b > a and not _EMPTY.fullmatch(text, a, b)]


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the four bytes from each place on; three fewer than bytes."""
    if len(data) < 4:
        return np.empty(0, dtype=np.int64)
    low = _LOWER[data].astype(np.uint32)
    symbol = np.flatnonzero(data == 0xE2)  # punctuation, bars and symbols of three bytes are no letters
    for step in range(3):
        low[np.minimum(symbol + step, len(low) - 1)] = 0x20
    four = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
    return ((four * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1, at least ten bits long, no bit the same for all, chosen for a large least distance.

    A fixed seed makes the choice the same everywhere.
    """
    length = max(10, math.ceil(4 * math.log2(max(n, 2))))
    rng = np.random.default_rng(7)
    best, far = None, (-1, -1.0)
    for _ in range(2000 if n <= 200 else 50):
        code = rng.integers(0, 2, (n, length)) * 2 - 1
        if n > 1 and (np.abs(code.sum(axis=0)) == n).any():
            continue
        f = code.astype(np.float32)
        apart = ((length - f @ f.T) / 2)[np.triu_indices(n, 1)] if n > 1 else np.zeros(1)
        if (int(apart.min()), float(apart.mean())) > far:
            best, far = code, (int(apart.min()), float(apart.mean()))
    return best.astype(np.float64)


class Model:
    """Codewords, and per bucket and bit the log-odds of the bit in sixty-fourths."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: language x bucket."""
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.2) / (counts.sum(axis=1, keepdims=True) + 0.2 * counts.shape[1])
        weights = []
        for bit in self.code.T:
            on, off = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
            weights.append(np.clip(np.log(on / off), -6, 6))
        self.weights = np.rint(np.stack(weights, axis=1) * 64).astype(np.int16)

    def losses(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Loss per block and language of the blocks data[start:end], given in order."""
        total = np.zeros((len(starts), self.weights.shape[1]))
        i = 0
        while i < len(starts):
            j = i + 1
            while j < len(starts) and ends[j] - starts[i] <= WINDOW:
                j += 1
            for a in range(int(starts[i]), int(ends[j - 1]), WINDOW):  # one step but for a block longer than the window
                b = min(a + WINDOW + 3, int(ends[j - 1]))
                bucket = grams(data[a:b])
                if not len(bucket):
                    continue
                s, e = np.clip(starts[i:j] - a, 0, len(bucket)), np.clip(ends[i:j] - 3 - a, 0, len(bucket))
                at = np.flatnonzero(e > s)
                if len(at):
                    cuts = np.stack([s[at], e[at]], axis=1).ravel()
                    rows = self.weights[bucket]
                    if cuts[-1] == len(bucket):
                        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), dtype=rows.dtype)])
                    total[i + at] += np.add.reduceat(rows, cuts, axis=0, dtype=np.int32)[::2]
            i = j
        margin = total / 64
        return np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(axis=2)


def label_language(label: Column, languages: list[tuple[str, str]]) -> Column:
    """The language a label names, by code, name, other code or own name; null if none."""
    first = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " ")))
    known = {**{k: v for k, v in OTHER_LABELS.items() if v in {c for c, _ in languages}}, **{n.lower(): c for c, n in languages if n}, **{c.lower(): c for c, _ in languages}}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, first), F.try_element_at(table, F.substring_index(F.translate(first, "_", "-"), "-", 1)))


def language_list(languages: DataFrame) -> list[tuple[str, str, list[str]]]:
    """Codes, names and samples; the list must have at most 1000 languages."""
    rows = languages.filter("lang is not null").select("lang", "lang_name", "samples").orderBy("lang").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("at most 1000 languages")
    return [(r[0], r[1], list(r[2] or [])) for r in rows]


def _count(texts: list[bytes], which: list[int], n: int) -> np.ndarray:
    counts = np.zeros((n, 1 << BITS))
    for text, k in zip(texts, which, strict=True):
        if len(b := grams(np.frombuffer(text, dtype=np.uint8))):
            counts[k] += np.bincount(b, minlength=1 << BITS)
    return counts


def fit(documents: DataFrame, languages: DataFrame, sample: int = SAMPLE) -> Model:
    """Classifiers from a bounded sample of labelled documents and the languages' sample sentences.

    About ``sample`` documents are taken by the hash of their id, at most
    twice as many.  Labels may be wrong: a first model, fitted to the labels,
    names the language of each block of the sample, and the second is fitted
    to those blocks that it names clearly.
    """
    known = language_list(languages)
    codes = [c for c, _, _ in known]
    label = label_language(F.col("lang"), [(c, n) for c, n, _ in known])
    total = documents.filter(label.isNotNull()).count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1)))
    rows = documents.filter(part & label.isNotNull() & F.col("text").isNotNull()).select(label.alias("l"), "text").limit(2 * sample).collect()
    seeds = [(s.encode(), i) for i, (_, _, samples) in enumerate(known) for s in samples if s]
    texts = [r[1].encode() for r in rows]
    where = [codes.index(r[0]) for r in rows]
    counts = _count(texts + [s for s, _ in seeds], where + [i for _, i in seeds], len(codes))
    model = Model(codes, counts)
    if not texts:
        return model
    clean: list[bytes] = []
    named: list[int] = []
    for text in texts:
        data = np.frombuffer(text, dtype=np.uint8)
        spans = blocks(text)
        if not spans:
            continue
        loss = model.losses(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
        order = np.sort(loss, axis=1)
        for (a, b), row, two in zip(spans, loss, order, strict=True):
            if len(codes) < 2 or two[1] - two[0] > 2 * GAP:
                clean.append(text[a:b])
                named.append(int(row.argmin()))
    return Model(codes, _count(clean + [s for s, _ in seeds], named + [i for _, i in seeds], len(codes)))


SEGMENTS = "doc_id long, label string, block_no int, n_bytes int, lang string, main string, confidence double, ambiguous boolean"


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """One row per block, numbered from 1, and one with number 0 for the whole document.

    ``lang`` is the block's language, ``main`` that of most of the document's
    bytes (a tie goes to the language first in order), ``confidence`` the
    softmax of the losses tempered by the text's length, and ``ambiguous``
    says that a second language lies within GAP.  A block gets the main language
    unless another is nearer by FOREIGN_GAP; one that is nearer by less is ``ambiguous``.  Null, empty and blank texts give no rows.
    """
    codes = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
            whole = memoryview(raw) if raw is not None else memoryview(b"")
            doc, no, starts, ends = [], [], [], []
            for i in range(len(texts)):
                o = int(offsets[i])
                for k, (a, b) in enumerate(blocks(bytes(whole[o : int(offsets[i + 1])])), 1):
                    doc.append(i)
                    no.append(k)
                    starts.append(o + a)
                    ends.append(o + b)
            yield from _rows(batch, model, codes, data, np.array(doc, dtype=np.int64), np.array(no, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64))

    return documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, SEGMENTS)


def _confidence(loss: np.ndarray, length: np.ndarray) -> np.ndarray:
    gain = -(loss - loss.min(axis=1, keepdims=True)) / (1 + np.sqrt(length))[:, None]
    p = np.exp(gain)
    return p.max(axis=1) / p.sum(axis=1)


def _rows(batch: pa.RecordBatch, model: Model, codes: list[str], data: np.ndarray, doc: np.ndarray, no: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    loss = model.losses(data, starts, ends)
    length = ends - starts
    best = loss.argmin(axis=1)
    two = np.sort(loss, axis=1)
    clear = two[:, 1] - two[:, 0] > GAP if loss.shape[1] > 1 else np.ones(len(loss), dtype=bool)
    sizes = np.zeros((len(batch), len(codes)))
    np.add.at(sizes, (doc[clear], best[clear]), length[clear])
    together = np.zeros((len(batch), len(codes)))
    np.add.at(together, doc, loss)
    bytes_of = np.bincount(doc, weights=length, minlength=len(batch))
    main = np.where(sizes.max(axis=1) > 0, sizes.argmax(axis=1), together.argmin(axis=1))
    shown = np.where(clear & (loss[np.arange(len(doc)), main[doc]] - two[:, 0] > FOREIGN_GAP), best, main[doc])
    there = np.unique(doc)
    names = np.array(codes, dtype=object)
    ids, labels = batch.column(0), batch.column(1)
    share = sizes[there].max(axis=1) / np.maximum(bytes_of[there], 1)
    for at, numbers, lang, sure, doubt, size in (
        (there, np.zeros(len(there)), main[there], _confidence(together[there], bytes_of[there]), share <= 0.5, bytes_of[there]),
        (doc, no, shown, _confidence(loss, length), ~clear | (shown != best), length),
    ):
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(take),
                labels.take(take),
                pa.array(numbers.astype(np.int32)),
                pa.array(size.astype(np.int32)),
                pa.array(names[lang], pa.string()),
                pa.array(names[main[at]], pa.string()),
                pa.array(sure.astype(np.float64)),
                pa.array(doubt),
            ],
            names=["doc_id", "label", "block_no", "n_bytes", "lang", "main", "confidence", "ambiguous"],
        )


def wrong_labels(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """``doc_id, block_no, lang``: documents whose label isn't their main language (number 0), and blocks in another language."""
    known = [(c, n) for c, n, _ in language_list(languages)]
    named = label_language(F.col("label"), known)
    off = F.when(F.col("block_no") == 0, ~named.eqNullSafe(F.col("lang"))).otherwise(F.col("lang") != F.col("main"))
    return rows.filter(off).select("doc_id", "block_no", "lang").distinct()
