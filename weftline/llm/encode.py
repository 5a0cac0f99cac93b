"""Token ids of whole texts by a public tokenizer, with content-defined reuse of chunks.

A rolling hash over the last eight bytes picks the cuts, so equal stretches of
different documents fall into equal chunks wherever they stand.  Each worker
encodes a chunk once and keeps its ids.  The hash chooses among the places
where a blank or line end follows another character: there the tokenizer's
pre-tokens end on either side whatever stands beyond, so the ids of chunks
laid end to end are those of the whole text and no join is left to repair.
The chunks that are new are encoded together, a line end between; one whose
ends then don't fall on tokens' ends is encoded again by itself.

No exchange: the ids leave the task that read the text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Folder with the public tokenizers' files.
FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: One in so many possible cuts is taken.
EVERY = 2
#: Bytes of chunks and ids that a worker keeps, about.
KEPT = 100_000_000
#: Bytes of text encoded and returned at once.
AT_ONCE = 1 << 22

# Fixed value: the pre-token pattern of byte-level BPE, as the public vocabulary's description gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}

_SHOWN = np.zeros(256, dtype=bool)
_SHOWN[0x21:0x7F] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x0A, 0x0D, 0x09]] = True


def encoder(folder: str = FOLDER, name: str = TOKENIZER):
    """Function from a text to its ids; the vocabulary is read once per worker.

    Byte-level BPE of ``tiktoken``; texts that its pattern engine gives up on
    (very long runs of blanks) go to ``tokenizers`` with the same vocabulary.
    """
    key = (folder, name)
    if key not in _loaded:
        import tiktoken

        lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        slow: list = []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001  # a panic of the pattern engine is no Exception and can't be imported
                if type(e).__name__ != "PanicException":
                    raise
                from tokenizers import Tokenizer

                if not slow:
                    slow.append(Tokenizer.from_file(str(Path(folder) / f"{name}.json")))
                    slow[0].encode_special_tokens = True
                return slow[0].encode(text, add_special_tokens=False).ids

        encode.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            encode.token_bytes[i] = len(token)
        _loaded[key] = encode
    return _loaded[key]


def cuts(data: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Places where a chunk may begin: before a blank that follows a shown ASCII character, one in ``every`` by the hash of the eight bytes before.

    The hash depends on those bytes alone, so the same words are cut alike in
    every document.
    """
    if len(data) < 10:
        return np.empty(0, dtype=np.int64)
    at = np.flatnonzero(_SHOWN[data[7:-1]] & _BLANK[data[8:]]) + 8
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    rolled = (eight[at - 8] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return at[rolled % np.uint64(every) == 0]


class Chunks:
    """Ids of the chunks seen so far, end to end in one pool, with each chunk's place in it.

    Emptied when it holds more than KEPT bytes.
    """

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool, self.start, self.size = array("i"), array("q"), array("q")
        self.bytes = 0

    def _keep(self, chunk: bytes, start: int, size: int) -> None:
        self.number[chunk] = len(self.start)
        self.start.append(start)
        self.size.append(size)
        self.bytes += 4 * size + len(chunk) + 150

    def add(self, new: list[bytes]) -> None:
        """Encode chunks that are all new.

        They are laid end to end, a line end between, and encoded in one call;
        the tokens' bytes tell where each chunk ends.  A chunk whose ends
        don't fall on tokens' ends is encoded again by itself, as are chunks
        that end in a blank, with which the line end would run together.
        """
        alone = [c for c in new if c[-1] in b" \t\r\n\x0b\x0c" or not c.isascii() and c.decode()[-1].isspace()]
        apart = set(alone)
        joined = [c for c in new if c not in apart]
        if joined:
            ids = np.array(self.encode(b"\n".join(joined).decode()), dtype=np.int32)
            ends = np.cumsum(self.encode.token_bytes[ids])
            length = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
            stop = np.cumsum(length + 1) - 1
            first, last = np.searchsorted(ends, stop - length, side="right"), np.searchsorted(ends, stop, side="left")
            begins = ends - self.encode.token_bytes[ids]
            good = (begins[first] == stop - length) & (ends[last] == stop)
            base = len(self.pool)
            self.pool.frombytes(ids.tobytes())
            for chunk, ok, a, b in zip(joined, good.tolist(), (base + first).tolist(), (last - first + 1).tolist(), strict=True):
                if ok:
                    self._keep(chunk, a, b)
                else:
                    alone.append(chunk)
        for chunk in alone:
            ids = self.encode(chunk.decode())
            self._keep(chunk, len(self.pool), len(ids))
            self.pool.extend(ids)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered chunks end to end, number of ids of each)."""
        start, size = np.frombuffer(self.start, dtype=np.int64)[numbers], np.frombuffer(self.size, dtype=np.int64)[numbers]
        before = np.cumsum(size) - size
        place = np.repeat(start - before, size) + np.arange(int(size.sum()))
        return np.frombuffer(self.pool, dtype=np.int32)[place] if len(place) else np.empty(0, dtype=np.int32), size


_cache: dict[tuple[str, str], Chunks] = {}


def chunks(folder: str = FOLDER, name: str = TOKENIZER) -> Chunks:
    """The worker's chunks; a worker that is used again finds them."""
    key = (folder, name)
    if key not in _cache:
        _cache[key] = Chunks(encoder(folder, name))
    return _cache[key]


def encode_buffer(raw: memoryview, offsets: np.ndarray, known: Chunks, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, number of ids of each) of the texts raw[offsets[i]:offsets[i+1]]."""
    base = int(offsets[0])
    data = np.frombuffer(raw, dtype=np.uint8)[base : int(offsets[-1])]
    if not len(data):
        return np.empty(0, dtype=np.int32), np.zeros(len(offsets) - 1, dtype=np.int64)
    if known.bytes > KEPT:
        known.clear()
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[cuts(data, every)] = True
    edge[offsets - base] = True
    edges = np.flatnonzero(edge)
    ends, whole = edges.tolist(), data.tobytes()
    pieces = [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    if new := [c for c in dict.fromkeys(pieces) if c not in known.number]:
        known.add(new)
    numbers = list(map(known.number.__getitem__, pieces))
    ids, size = known.gather(np.array(numbers, dtype=np.int64))
    upto = np.concatenate([[0], np.cumsum(size)])
    return ids, np.diff(upto[np.searchsorted(edges, offsets - base)])


def _texts(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return memoryview(raw) if raw is not None else memoryview(b""), offsets


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about AT_ONCE bytes; a longer text is a run of its own."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + AT_ONCE, side="right")) - 1)
        yield i, j
        i = j


def encode_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """``id_col, ids`` of every row: the text's token ids without special tokens.

    A null text gives an empty list, as an empty one does.  What looks like a
    special token in a text is ordinary text.  Repeated rows are kept, other
    columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(folder, name)
        for batch in batches:
            raw, offsets = _texts(batch.column(1))
            for i, j in _stretches(offsets):
                ids, lengths = encode_buffer(raw, offsets[i : j + 1], known)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of the text's tokens; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(folder, name)
        for batch in batches:
            raw, offsets = _texts(batch.column(batch.num_columns - 1))
            counts = [encode_buffer(raw, offsets[i : j + 1], known)[1] for i, j in _stretches(offsets)]
            n = pa.array(np.concatenate(counts) if counts else np.empty(0, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"{schema}, n_tokens long")
