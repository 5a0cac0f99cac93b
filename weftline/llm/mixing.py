"""Sources mixed to target shares of all tokens.

Documents belong to sources softly: with certainty where the source is named,
else by the posterior of a classifier fitted to a sample of labelled rows.
One pass counts tokens and posteriors; its sums per group of like documents
are all that the least squares needs, so projected gradient runs on a small
matrix however many documents there are.  Rates become whole copies by a hash
of the document: those below a threshold get one more, and the threshold is
found from token histograms over hash buckets, finer where it falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm import encode
from weftline.llm.language import Model, _count
from weftline.session import durable

#: Sources that a mixture may have: the driver holds a sum per source and hash bucket, and tables of a row or two a source are broadcast.
MOST_SOURCES = 500
#: Labelled documents in the classifier's sample, about; at most twice as many are ever collected.
SAMPLE = 1500
#: Documents of a source in that sample, at least, so that small sources have their share.
LEAST = 30
#: Hash buckets per level.
BUCKETS = 4096


def target_list(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, most repeats), shares scaled to a sum of one; rows with null, no share or no repeats are left out.

    At most MOST_SOURCES; a source given twice is an error.
    """
    rows = targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r[0] for r in rows}) < len(rows):
        raise ValueError(f"targets must name at most {MOST_SOURCES} sources, each once")
    total = sum(r[1] for r in rows)
    return [(r[0], r[1] / total, int(r[2])) for r in rows]


def fit_sources(documents: DataFrame, sources: list[str], sample: int = SAMPLE) -> Model | None:
    """Classifier of sources from about ``sample`` labelled documents; None without any.

    Every source gets as many, at least LEAST, or all it has if fewer; they
    are taken by the hash of their id.  At most twice that number is ever
    collected.
    """
    texts = documents.filter("text is not null and source is not null").select("doc_id", "source", "text")
    counts = {r[0]: r[1] for r in texts.groupBy("source").count().join(F.broadcast(_names(documents, sources)), "source", "left_semi").collect()}  # one row a source
    if not counts:
        return None
    each = max(LEAST, sample // len(counts))
    shares = documents.sparkSession.createDataFrame([(s, int((1 << 30) * min(1.0, each / n))) for s, n in counts.items()], "source string, below long")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below")
    rows = texts.join(F.broadcast(shares), "source").filter(part).select("source", "text").limit(2 * each * len(counts)).collect()
    place = {s: i for i, s in enumerate(sources)}
    return Model(sources, _count([r[1].encode() for r in rows], [place[r[0]] for r in rows], len(sources)))


def _names(documents: DataFrame, sources: list[str]) -> DataFrame:
    return documents.sparkSession.createDataFrame([(s,) for s in sources], "source string")


def measure(documents: DataFrame, sources: list[str], model: Model | None, folder: str = encode.FOLDER, name: str = encode.TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, likely, posterior`` of every document.

    ``posterior`` has one entry per source; it is null for documents that name
    a source, which belong to it wholly.  ``likely`` is the named or the most
    likely source, null for a name that isn't in the list.  Null and empty
    texts have no tokens.
    """
    known = set(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encode.chunks(folder, name)
        for batch in batches:
            raw, offsets = encode._texts(batch.column(2))
            data = np.frombuffer(raw, dtype=np.uint8)
            counts = [encode.encode_buffer(raw, offsets[i : j + 1], chunks)[1] for i, j in encode._stretches(offsets)]
            named = batch.column(1).to_pylist()
            likely, posterior = list(named), [None] * len(named)
            unsure = [i for i, s in enumerate(named) if s not in known]
            for i in unsure:
                likely[i] = None
                if model is not None and not (named[i] or "").strip() and offsets[i + 1] > offsets[i]:
                    loss = model.losses(data, offsets[i : i + 1], offsets[i + 1 : i + 2])[0]
                    p = np.exp(-(loss - loss.min()) / (1 + np.sqrt(offsets[i + 1] - offsets[i])))
                    posterior[i] = (p / p.sum()).tolist()
                    likely[i] = sources[int(np.argmax(p))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.concatenate(counts) if counts else np.empty(0, dtype=np.int64), pa.int64()),
                    pa.array(likely, pa.string()),
                    pa.array(posterior, pa.list_(pa.float64())),
                ],
                names=["doc_id", "source", "n_tokens", "likely", "posterior"],
            )

    slim = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, source string, n_tokens long, likely string, posterior array<double>")


def projected_gradient(tokens: np.ndarray, caps: np.ndarray, goal: np.ndarray, rounds: int = 20_000, close: float = 1e-12) -> np.ndarray:
    """Rates in [0, cap] per group for which expected tokens per source come nearest to ``goal`` in least squares.

    ``tokens``: group x source.  Columns are scaled by the goal, so sources
    count alike whatever their size.
    """
    a = (tokens / np.maximum(goal, 1e-9)).T
    b = np.ones(len(goal))
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-30)
    scale = np.maximum(np.abs(a).max(axis=0), 1e-30)  # each group in its own unit, else small groups never move
    a, caps_in = a / scale, caps * scale
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-30)
    x = np.zeros(a.shape[1])
    for _ in range(rounds):
        new = np.clip(x - step * (a.T @ (a @ x - b)), 0, caps_in)
        if np.abs(new - x).max(initial=0) < close:
            x = new
            break
        x = new
    return x / scale


def _bucket(level: int) -> Column:
    """Hash bucket of a document at a level; levels use different bits."""
    return F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit(9)), 12 * level), F.lit(BUCKETS)).cast("int")


def thresholds(rows: DataFrame, extra: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """Per source the hash place (three levels of buckets) below which documents get one copy more, so that these hold ``extra`` tokens as nearly as whole documents allow.

    Each level counts tokens per bucket, at most sources x BUCKETS sums; the
    next looks only into the bucket where the threshold falls.
    """
    place: dict[str, list[int]] = {s: [] for s in extra}
    left = dict(extra)
    for level in range(3):
        inside = F.lit(False)
        for s, at in place.items():
            here = F.col("source") == s
            for up, b in enumerate(at):
                here = here & (_bucket(up) == b)
            inside = inside | here
        sums: dict[str, dict[int, int]] = {}
        for r in rows.filter(inside).groupBy("source", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
            sums.setdefault(r["source"], {})[r["b"]] = r["n"]
        for s in place:
            run = 0
            for b in sorted(sums.get(s, {})):
                n = sums[s][b]
                if run + n > left[s]:
                    break
                run += n
            else:
                b = BUCKETS
            if level == 2 and b < BUCKETS and run + sums[s][b] / 2 <= left[s]:
                b += 1  # the last document goes to the nearer side
            left[s] -= run
            place[s].append(b)
    return {s: tuple(at) for s, at in place.items()}


def largest(tokens: np.ndarray, caps: np.ndarray, share: np.ndarray, close: float = 1e-4) -> float:
    """Largest size at which the fit gives every source its share, by halving below the size that the scarcest source allows."""
    top = min((float(x) for x in caps @ tokens / share), default=0.0)
    miss = lambda size: np.abs(projected_gradient(tokens, caps, share * size) @ tokens / (share * size) - 1).max(initial=0)
    if top <= 0 or miss(top) <= close:
        return top
    low, high = 0.0, top
    for _ in range(14):
        middle = (low + high) / 2
        low, high = (middle, high) if miss(middle) <= close else (low, middle)
    return low or top


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, unlabelled: bool = False) -> DataFrame:
    """``doc_id, source, n_tokens, copies, rate, likely, membership``: how often each document is taken.

    Every document comes out, also those taken no time.  ``copies`` is at most
    the source's ``max_repeats``.  ``total`` is the mixture's size in tokens;
    by default the largest at which every source with tokens can reach its
    share.  Documents that name no source take part only with ``unlabelled``,
    by their posterior, which ``membership`` gives per source, and with the
    ``max_repeats`` of their most likely source.  Documents that name a source
    not in ``targets`` are of none of those to be mixed; their rate is 0.
    Sources without tokens can't contribute; the others keep their
    proportions.  An empty table gives an empty mixture.
    """
    aims = target_list(targets)
    sources = [s for s, _, _ in aims]
    caps = {s: c for s, _, c in aims}
    model = fit_sources(documents, sources) if sources else None
    # groups of like documents: of a named source, or of a most likely one
    group = F.when(F.col("posterior").isNull() & F.col("likely").isNotNull(), F.concat(F.lit("="), "source"))
    if unlabelled:
        group = group.when(F.col("posterior").isNotNull(), F.concat(F.lit("?"), "likely"))
    rows = durable(measure(documents, sources, model).withColumn("group", group))
    parts = [F.sum(F.when(F.col("posterior").isNotNull(), F.col("posterior")[i]).otherwise((F.col("source") == s).cast("double")) * F.col("n_tokens")).alias(f"s{i}") for i, s in enumerate(sources)]
    sums = rows.filter("group is not null").groupBy("group").agg(F.sum("n_tokens").alias("n"), *parts).filter("n > 0").orderBy("group").collect()  # at most two rows a source
    n = {r["group"]: float(r["n"]) for r in sums}
    rate: dict[str, float] = {}
    if sums:
        tokens, limit = np.array([[r[f"s{i}"] for i in range(len(sources))] for r in sums]), np.array([float(caps[g[1:]]) for g in n])
        keep = np.array([f"={s}" in n or f"?{s}" in n for s in sources])
        share = np.array([a[1] for a in aims])[keep]
        share /= share.sum()
        fitted = projected_gradient(tokens[:, keep], limit, share * (total if total is not None else largest(tokens[:, keep], limit, share)))
        rate = {g: float(x) for g, x in zip(n, fitted, strict=True)}
    whole = {g: min(int(r + 1e-9), caps[g[1:]]) for g, r in rate.items()}
    extra = {g: max(0.0, rate[g] - whole[g]) * n[g] for g in rate if whole[g] < caps[g[1:]]}
    extra = {g: x for g, x in extra.items() if x > 0.5}
    at = thresholds(rows.select("doc_id", F.col("group").alias("source"), "n_tokens").filter("source is not null"), extra) if extra else {}
    spark = documents.sparkSession
    plan = [(g, float(r), whole[g], *at.get(g, (0, 0, 0))) for g, r in rate.items()]
    plans = spark.createDataFrame(plan, "group string, rate double, whole int, p0 int, p1 int, p2 int")  # at most two rows a source
    here, upto = F.struct(*(_bucket(i).alias(f"b{i}") for i in range(3))), F.struct(*(F.col(f"p{i}").alias(f"b{i}") for i in range(3)))
    planned = rows.join(F.broadcast(plans), "group", "left")
    copies, shown = F.coalesce(F.col("whole") + F.when(here < upto, 1).otherwise(0), F.lit(0)), F.coalesce("rate", F.lit(0.0))
    names = F.array(*(F.lit(s) for s in sources)).cast("array<string>")
    return planned.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies"), shown.alias("rate"), "likely", F.map_from_arrays(names, "posterior").alias("membership"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, documents, tokens, actual_share, most_copies, soft_tokens, labelled_share`` of every source in ``targets``, also those without documents.

    ``documents``, ``tokens`` and ``most_copies`` are of the documents that
    name the source; ``soft_tokens`` are those of documents without a source,
    by their membership.  ``actual_share`` counts both, ``labelled_share`` only
    the former, each of all tokens taken.
    """
    taken = F.col("n_tokens") * F.col("copies")
    per = mixture.groupBy("source").agg(F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"), F.sum(taken).alias("tokens"), F.max("copies").alias("most_copies"))
    per = durable(per)
    soft = mixture.filter("copies > 0 and membership is not null").select(taken.alias("n"), F.explode("membership").alias("source", "p")).groupBy("source").agg(F.sum(F.col("n") * F.col("p")).alias("soft"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    total = (whole.first() or [0])[0] or 0
    filled = targets.select("source", "target_share").join(per, "source", "left").join(soft, "source", "left")
    tokens, credited = F.coalesce("tokens", F.lit(0)), F.coalesce("soft", F.lit(0.0))
    return filled.select(
        "source",
        "target_share",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        tokens.alias("tokens"),
        ((tokens + credited) / F.lit(total) if total else F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        credited.alias("soft_tokens"),
        (tokens / F.lit(total) if total else F.lit(0.0)).alias("labelled_share"),
    )


def expand(mixture: DataFrame) -> DataFrame:
    """The mixture with one row per copy, numbered from 1 in ``copy``."""
    return mixture.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
