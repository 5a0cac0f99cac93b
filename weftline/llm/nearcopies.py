"""Records that share most of their words, found by a multi-index Hamming join.

A record's word set is hashed to chunks.  Each chunk's signature is the
exclusive or of its words' 64-bit hashes, so equal words cancel and two records
whose sets differ in d words differ in at most d places over all chunks.  By
the pigeonhole principle one of m chunks differs in at most floor(d / m)
places.  Records fall into bands by size, and a band has floor(d / 2) + 1
chunks, so that one chunk differs in at most one word, which one of the two
records has more there.  Every record enters each chunk's signature, and probes
with each signature that removing one of its words from the chunk gives; of a
pair within the threshold at least one chunk meets.  (With two errors a chunk
may hold one word for another, which removal on one side never undoes.)
Similarity s allows d = (1-s)/(1+s) * (|A|+|B|) differing words, so no pair is
lost, whatever the sizes.

Exact copies are one class and enter the index once.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftline.llm.lookalike import WORD, to_one_form
from weftline.operators.cluster import both_ways, components
from weftline.session import durable

#: Most words a record can have.
MOST = 2**31
#: Keys after which a batch of them is handed on.
HELD = 50_000
#: Words in at least this share of the classes are dealt to the chunks in turn; there are at most average set size / share of them.
FREQUENT = 0.005


def hashed_words(title: str | None, features: list[tuple[str, str | None]]) -> list[int]:
    """Sorted 64-bit hashes of the distinct words of a title and of features' values."""
    words = {w for text in [title, *(v for _, v in features)] if text for w in WORD.findall(text.lower())}
    return sorted(xxhash.xxh64_intdigest(w) - 2**63 for w in words)


def word_sets(forms: DataFrame) -> DataFrame:
    """``rid, words`` of ``rid, title, features`` in one form: sorted 64-bit hashes of the distinct words.

    A word is a maximal run of letters and digits of the title or a feature's
    value, in lower case.  Records without any word get an empty array.  Of
    several different rows of a rid the one with the smallest words holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed_words(t, [(e["key"], e["value"]) for e in f or []]) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rid", "words"])

    return forms.select("rid", "title", "features").mapInArrow(run, "rid long, words array<long>").groupBy("rid").agg(F.min("words").alias("words"))


def bands(similarity: float) -> list[tuple[int, int, int]]:
    """(from size, to size, chunks) of the larger record of a pair, with so many chunks that one of them differs in at most one word."""
    out, low = [], 1
    while low < MOST:
        high = max(low + 1, math.ceil(low / similarity), low + low // 16)
        out.append((low, high, most_apart(similarity, high - 1, high - 1) // 2 + 1))
        low = high
    return out


def most_apart(similarity: float, a: int, b: int) -> int:
    """Most words in which sets of these sizes may differ."""
    return math.floor((1 - similarity) / (1 + similarity) * (a + b) + 1e-9)


@lru_cache(maxsize=256)
def _tags(band: int, m: int) -> np.ndarray:
    """One hash per chunk of a band."""
    return np.array([xxhash.xxh64_intdigest(b"%d:%d:%d" % (band, m, c)) for c in range(m)], dtype=np.uint64)


def _keys(words: np.ndarray, place: np.ndarray, band: int, m: int, probe: bool) -> list[np.ndarray]:
    """The keys of all chunks, and with ``probe`` those with one word removed; as many as chunks and words."""
    chunk = place % m
    whole = _tags(band, m).copy()
    np.bitwise_xor.at(whole, chunk, words)
    return [whole, whole[chunk] ^ words] if probe else [whole]


def index_keys(classes: DataFrame, similarity: float, frequent: dict[int, int], probe: bool) -> DataFrame:
    """``key, rep, n, removed, mark`` of classes ``rep, words``; ``mark`` is a 64-bit signature of the whole set.

    With ``probe`` the signatures with words removed come too.
    """
    levels, share = bands(similarity), (1 - similarity) / (1 + similarity)
    ends = [high for _, high, _ in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, list, list, list, list] = ([], [], [], [], [])
            held = 0

            def flush():
                arrays = [np.concatenate(c) if c else np.array([], dtype=k) for c, k in zip(cols, (np.uint64, np.int64, np.int32, np.int32, np.int64), strict=True)]
                for c in cols:
                    c.clear()
                return pa.RecordBatch.from_arrays(
                    [pa.array(arrays[0].view(np.int64)), pa.array(arrays[1], pa.int64()), pa.array(arrays[2], pa.int32()), pa.array(arrays[3], pa.int32()), pa.array(arrays[4], pa.int64())],
                    names=["key", "rep", "n", "removed", "mark"],
                )

            for rep, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(words)
                signed = np.array(words, dtype=np.int64)
                h = signed.view(np.uint64)
                place = np.array([frequent.get(w, w & 0x7FFFFFFF) for w in words], dtype=np.int64)
                bits = np.bitwise_xor.reduce(np.left_shift(np.uint64(1), (h >> np.uint64(20)) & np.uint64(63))) if n else np.uint64(0)
                for band in range(bisect_right(ends, n), len(levels)):
                    low, high, m = levels[band]
                    if math.ceil(similarity * low - 1e-9) > n:
                        break
                    apart = math.floor(share * min(2 * (high - 1), n * (1 + 1 / similarity)) + 1e-9)
                    for removed, keys in enumerate(_keys(h, place, band, m, probe and apart >= m)):
                        held += len(keys)
                        for column, v in zip(cols, (keys, *(np.full(len(keys), x, dtype=k) for x, k in ((rep, np.int64), (n, np.int32), (removed, np.int32), (bits.view(np.int64), np.int64)))), strict=True):
                            column.append(v)
                if held >= HELD:
                    yield flush()
                    held = 0
            yield flush()

    return classes.mapInArrow(run, "key long, rep long, n int, removed int, mark long")


def copy_classes(sets: DataFrame) -> DataFrame:
    """``rid, rep`` of every record with at least one word: rep is the smallest rid with the same words."""
    small = sets.filter(F.size("words") > 0).select("rid", F.xxhash64("words").alias("a"), F.md5(F.array_join("words", ",")).alias("b"))
    reps = small.groupBy("a", "b").agg(F.min("rid").alias("rep"))
    return small.join(reps, ["a", "b"]).select("rid", "rep")


def similar_classes(sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``rep_a, rep_b, common, similarity`` of all pairs of different classes at or above the similarity."""
    spark = sets.sparkSession
    reps = sets.join(classes.filter("rid = rep").select("rid"), "rid").select(F.col("rid").alias("rep"), "words")
    reps = durable(reps)
    total = reps.count()
    usual = (
        reps.select(F.explode("words").alias("w"))
        .groupBy("w")
        .count()
        .filter(F.col("count") >= max(2, FREQUENT * total))
        .orderBy(F.desc("count"), "w")
        .collect()  # at most (average words per record / FREQUENT) rows
    )
    dealt = {r["w"]: i for i, r in enumerate(usual)}
    keys = index_keys(reps, similarity, dealt, probe=True)
    share = (1 - similarity) / (1 + similarity)
    full = index_keys(reps, similarity, dealt, probe=False).select("key", F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("mark").alias("mark_b"))
    near = (
        (F.col("rep") != F.col("rep_b"))
        & ((F.col("removed") > 0) | (F.col("rep") < F.col("rep_b")))
        & (F.bit_count(F.col("mark").bitwiseXOR(F.col("mark_b"))) <= F.floor((F.col("n") + F.col("n_b")) * share + 1e-9))
        & (F.least("n", "n_b") >= F.greatest("n", "n_b") * similarity - 1e-9)
    )
    pairs = keys.join(full, "key").filter(near).select(F.least("rep", "rep_b").alias("rep_a"), F.greatest("rep", "rep_b").alias("rep_b")).distinct()
    a = reps.select(F.col("rep").alias("rep_a"), F.col("words").alias("words_a"))
    b = reps.select(F.col("rep").alias("rep_b"), F.col("words").alias("words_b"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    exact = pairs.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", common.alias("common"), (F.size("words_a") + F.size("words_b") - common).alias("union"))
    return exact.filter(F.col("common") >= F.col("union") * similarity - 1e-9).select("rep_a", "rep_b", "common", (F.col("common") / F.col("union")).alias("similarity"))


def near_copies(records: DataFrame, similarity: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Membership ``rid, rep`` and class pairs ``rep_a, rep_b, common, similarity``.

    ``records`` has ``rid, title, features``, which are brought to one form
    first.  Records without any word are in no class.  Exact copies are one
    class; they are not expanded into pairs.  An empty table gives none.
    """
    sets = durable(word_sets(to_one_form(records)))
    classes = durable(copy_classes(sets))
    return classes, similar_classes(sets, classes, similarity)


def rid_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rid_a, rid_b`` (a < b) of all records in one class or in two similar classes.

    The result names each pair, so it grows with the square of the largest
    class; a class's members are exploded from the other side row by row, no
    group is gathered in a task.
    """
    member = lambda side: classes.select(F.col("rep").alias(f"rep_{side}"), F.col("rid").alias(f"rid_{side}"))
    same = member("a").join(member("b"), F.col("rep_a") == F.col("rep_b")).filter("rid_a < rid_b").select("rid_a", "rid_b")
    other = pairs.join(member("a"), "rep_a").join(member("b"), "rep_b").select(F.least("rid_a", "rid_b").alias("rid_a"), F.greatest("rid_a", "rid_b").alias("rid_b"))
    return same.unionByName(other)


def groups(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rid, group, links``: each record's group, the connected component of the similar classes, and its number of links.

    Links count the other records at or above the similarity.  Labels shrink
    to the smallest rid of the component by repeated joins; each round is
    written to the shared checkpoint folder.
    """
    edges = durable(both_ways(pairs.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))))
    labels = components(edges)
    size = classes.groupBy("rep").agg(F.count("*").alias("n"))
    near = edges.join(size.select(F.col("rep").alias("v"), "n"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    return (
        classes.join(size, "rep")
        .join(near, "rep", "left")
        .join(labels.withColumnRenamed("u", "rep"), "rep", "left")
        .select("rid", F.coalesce("label", "rep").alias("group"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    )
