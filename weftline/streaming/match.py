"""New records matched against a standing bucket table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.config import DedupConfig
from weftline.operators import minhash, tokens, vectors


def match_stream(stream: DataFrame, vocab: DataFrame, buckets: DataFrame, config: DedupConfig):
    """A writer of streamed records ``rid, title, features`` whose batches are matched to ``buckets``.

    Use as ``match_stream(...)(sink)``: ``sink(matches, epoch)`` gets
    ``rid, partner`` of each batch, every pair once.  The standing side is a
    static table, so nothing is kept in state; a batch that is replayed gives
    the same matches.  Words outside the vocabulary are ignored.
    """

    def with_sink(sink):
        def each(batch: DataFrame, epoch: int) -> None:
            cleaned = tokens.clean(batch)
            sigs = minhash.signatures(vectors.binary_vectors(cleaned, vocab), config)
            own = minhash.bands(sigs, config)
            standing = buckets.select(F.col("rid").alias("partner"), "band", "bucket")
            sink(own.join(standing, ["band", "bucket"]).filter("rid <> partner").select("rid", "partner").distinct(), epoch)

        return stream.writeStream.foreachBatch(each)

    return with_sink
