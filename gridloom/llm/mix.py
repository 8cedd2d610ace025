"""Mixing sources to target weights (problem 8).

Each document of a source gets the expected number of copies that the plan asks of the source,
at most ``max_repeats``.  The whole part is given to every document; the fractional part is rounded
by pivotal sampling: two fractional documents are paired and mass, measured in tokens, moves at
random from one to the other until one is whole, which keeps the tokens of the source and every
document's expectation.  Documents are paired within hashed buckets of bounded size; the one
fraction that each bucket leaves is combined with others through a reduction tree, so that a source
misses its target by less than one document whatever its size.  Sizes are tokens of a public
tokenizer whose file is a parameter.

Defined results for odd input:

* a null or empty text has no tokens; a document without tokens gets whole copies only;
* a document without source belongs to no plan, but counts in the size of all documents;
* a planned source without documents reaches share 0; a source that no plan names is left out;
* a source that cannot reach its share within ``max_repeats`` gives all it may; the shares really
  reached say so, nothing is shifted to other sources;
* repeated rows of a document count once; equal inputs and seed give equal results, on retries too.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import write_through

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this byte-level vocabulary.
TOKENIZER_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that are paired in one task, and residuals that are combined in one.
BUCKET_ROWS = 20_000
FAN_IN = 64
#: Plans times sources that may be broadcast.
MAX_RATES = 100_000


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=TOKENIZER_PATTERN, mergeable_ranks=table, special_tokens={})


def _count_column(shared):
    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        encode = _encoding(shared.value).encode_ordinary
        return pd.Series([0 if t is None else len(encode(t)) for t in text], dtype="int64")

    return count


def token_counts(documents: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, source, n_tokens of every document; the vocabulary file is sent to the executors."""
    with open(tokenizer_file, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    counted = documents.where("doc_id IS NOT NULL").select("doc_id", "source", _count_column(shared)("text").alias("n_tokens"))
    return counted.groupBy("doc_id").agg(F.max(F.struct(F.col("source").isNotNull(), "n_tokens", "source")).alias("held")).select("doc_id", "held.source", "held.n_tokens")


def _pair(p: float, w: float, q: float, v: float, chance: float) -> tuple[float, float]:
    """Move tokens between two fractions until one is whole; the expectation of both stays."""
    up, down = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
    moved = up if chance * (up + down) < down else -down
    p, q = p + moved / w, q - moved / v
    near = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
    return near(p), near(q)


def round_pivotal(fraction: np.ndarray, size: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Fractions after pairing in order, and the place of the one that is left (-1: none is)."""
    chances = np.random.Generator(np.random.PCG64(seed)).random(len(fraction))
    p, w = fraction.astype(float).copy(), np.maximum(size.astype(float), 1e-6)
    held = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        p[held], p[i] = _pair(p[held], w[held], p[i], w[i], chances[i])
        if 0 < p[i] < 1:
            held = i
        elif not 0 < p[held] < 1:
            held = -1
    return p, held


PICKS = "plan_name string, source string, bucket long, doc_id long, n_tokens long, fraction double, place long"


def _round_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["place", "doc_id"], ignore_index=True)
    first = pdf.iloc[0]
    seed = int(pd.util.hash_array(np.array([f"{first.plan_name}/{first.source}/{first.bucket}/{len(pdf)}/{first.place}"], object))[0])
    pdf["fraction"], _ = round_pivotal(pdf.fraction.to_numpy(), pdf.n_tokens.to_numpy(), seed)
    return pdf


def source_rates(tokens: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Expected copies of each document by plan and source, and the number of its buckets."""
    sizes = tokens.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("available")).first()[0] or 0
    targets = mix_targets.where("plan_name IS NOT NULL AND source IS NOT NULL").groupBy("plan_name", "source").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "size_ratio")))
    wanted = (F.col("target_share") * F.col("size_ratio") * F.lit(float(total))).alias("target_tokens")
    return targets.join(sizes.where("source IS NOT NULL"), "source", "left").select(
        "plan_name",
        "source",
        "target_share",
        wanted,
        F.coalesce("available", F.lit(0)).alias("available"),
        F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.greatest(wanted / F.col("available"), F.lit(0.0)))).otherwise(0.0).alias("copies"),
        F.ceil(F.coalesce("rows", F.lit(0)) / BUCKET_ROWS).alias("buckets"),
    )


def mix(documents: DataFrame, mix_targets: DataFrame, tokenizer_file: str = TOKENIZER_FILE, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(plan_name, source, doc_id, n_tokens, copies) with at least one copy, and the rates."""
    tokens = write_through(token_counts(documents, tokenizer_file), "tokens")
    rates = write_through(source_rates(tokens, mix_targets), "rates")
    bounded = rates.count() <= MAX_RATES
    use = (F.broadcast if bounded else lambda x: x)(rates.where("copies > 0").select("plan_name", "source", "copies", "buckets"))
    place = F.xxhash64(F.lit(seed), "doc_id")
    copies = tokens.join(use, "source").withColumns({"place": place, "whole": F.floor("copies"), "fraction": F.when(F.col("n_tokens") > 0, F.col("copies") - F.floor("copies")).otherwise(0.0)})
    open_ones = copies.where("fraction > 0").select("plan_name", "source", F.pmod("place", "buckets").alias("bucket"), "doc_id", "n_tokens", "fraction", "place")
    picked = []
    largest = rates.agg(F.max("buckets")).first()[0] or 0
    while True:
        level = write_through(open_ones.groupBy("plan_name", "source", "bucket").applyInPandas(_round_bucket, PICKS), "picks")
        picked.append(level.where("fraction = 1"))
        left = level.where("fraction > 0 AND fraction < 1")
        if largest <= 1:
            break
        largest = -(-largest // FAN_IN)
        open_ones = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    # the last fraction of a source is drawn by its own probability
    unit = (F.pmod(F.xxhash64(F.lit(seed + 1), "plan_name", "doc_id"), F.lit(1 << 30)) / (1 << 30)).cast("double")
    picked.append(left.where(unit < F.col("fraction")))
    extra = functools.reduce(DataFrame.unionByName, picked).select("plan_name", "source", "doc_id", "n_tokens", F.lit(1).cast("long").alias("copies"))
    whole = copies.where("whole > 0").select("plan_name", "source", "doc_id", "n_tokens", F.col("whole").alias("copies"))
    return whole.unionByName(extra).groupBy("plan_name", "source", "doc_id", "n_tokens").agg(F.sum("copies").alias("copies")), rates


def reached_shares(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """The share that each source of each plan really reached, in tokens."""
    got = mixed.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    both = rates.join(got, ["plan_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = both.groupBy("plan_name").agg(F.sum("tokens").alias("plan_tokens"))
    return both.join(whole, "plan_name").select(
        "plan_name",
        "source",
        "target_share",
        F.when(F.col("plan_tokens") > 0, F.col("tokens") / F.col("plan_tokens")).otherwise(0.0).alias("reached_share"),
        "target_tokens",
        "tokens",
        "documents",
        "most_copies",
    )


def kept_limits(mixed: DataFrame, rates: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """plan_name, source, within_repeats, near_target: whether no document is used too often, and whether the
    tokens are those wanted, or all there may be, to within one document."""
    got = mixed.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most"), F.max("n_tokens").alias("largest"))
    repeats = mix_targets.groupBy("plan_name", "source").agg(F.max("max_repeats").alias("max_repeats"))
    both = rates.join(repeats, ["plan_name", "source"]).join(got, ["plan_name", "source"], "left").na.fill(0, ["tokens", "most", "largest"])
    largest = F.max("largest").over(Window.partitionBy("plan_name"))
    gap = F.abs(F.col("tokens") - F.col("copies") * F.col("available"))
    return both.select("plan_name", "source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (gap <= largest).alias("near_target"))
