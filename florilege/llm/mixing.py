"""Mixing sources to target shares of all tokens, as a time-varying curriculum.

Each source has a weight schedule over the training time 0..1 whose integral is its target share.
A document starts where the tokens of its source, in a fixed random order and repeated as often as
needed, reach its turn; inverting the source's cumulative token demand there gives its training
position. The mix is range-sorted by position.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.session import stage

#: The vocabulary (ranks file) that sizes are counted with; a parameter, never copied here.
TOKENIZER = os.environ.get("FLORILEGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how byte-level BPE cuts a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one bucket of the running token sums.
BUCKET_DOCS = 50_000
#: How strongly the schedule of sources above their natural share rises over the training time (0: constant weights).
TILT = 0.5


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) over whole texts; 0 for null and empty ones."""
    from pathlib import Path

    name, pattern, ranks_text = Path(tokenizer).name, PATTERN, Path(tokenizer).read_bytes()
    shared = documents.sparkSession.sparkContext.broadcast(ranks_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


@dataclass(frozen=True)
class SourcePlan:
    """What one source gives: its tokens, its target among all sources, its part of this mix, the tokens wanted, and its schedule's slope."""

    source: str
    tokens: int
    documents: int
    target_share: float
    mix_share: float
    max_repeats: int
    wanted: float
    tilt: float


def plan_mix(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total_tokens: float | None = None, tilt: float = TILT) -> list[SourcePlan]:
    """Tokens wanted of each source.

    Sources without tokens, without a share or that may not be used are left out and the other
    shares scaled up in proportion. The total is as large as every source can fill with its share
    within its repeats; a smaller one may be asked for. One that is larger than that cannot be filled
    without changing the shares, and raises.
    """
    usable = [(s, share, reps) for s, share, reps in targets if s is not None and share and share > 0 and reps and reps > 0 and totals.get(s, (0, 0))[0] > 0]
    weight = sum(share for _, share, _ in usable)
    if not usable:
        return []
    most = min(reps * totals[s][0] / (share / weight) for s, share, reps in usable)
    if total_tokens is not None and total_tokens > most * (1 + 1e-9):
        raise ValueError(f"{total_tokens} tokens are asked for, but with these shares and repeats the sources fill {most:.0f}")
    total = total_tokens if total_tokens is not None else most
    all_tokens = sum(totals[s][0] for s, *_ in usable)
    raw = {s: tilt if share / weight > totals[s][0] / all_tokens else -tilt for s, share, _ in usable}
    middle = sum(share / weight * raw[s] for s, share, _ in usable)  # taken off, so that the weights sum to 1 at every time
    largest = max([1.0, *(abs(raw[s] - middle) for s, *_ in usable)])
    return [SourcePlan(s, totals[s][0], totals[s][1], share, share / weight, int(reps), total * share / weight, (raw[s] - middle) / largest) for s, share, reps in usable]


def demand(t: float, plan: SourcePlan) -> float:
    """Tokens of the source wanted up to time t: the integral of its schedule share * (1 + tilt * (2t - 1))."""
    return plan.wanted * (t + plan.tilt * (t * t - t))


def position(filled: Column, tilt: Column) -> Column:
    """The time at which the demand reaches a part of what is wanted: the demand's inverse."""
    u = F.least(F.greatest(filled, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt(F.greatest((1 - tilt) * (1 - tilt) + 4 * tilt * u, F.lit(0.0)))
    return F.coalesce(F.try_divide(2 * u, (1 - tilt) + root), F.lit(0.0))


def _starts(sized: DataFrame, buckets: int) -> DataFrame:
    """Tokens of the source before each document, in hash order: sums of hash buckets first, then inside each bucket."""
    hashed = sized.withColumn("h", F.xxhash64("doc_id", F.lit(7))).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32)).cast("double") / 2.0**32 * buckets).cast("int"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "bucket", before.alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = hashed.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return within.join(sums, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("bucket_start") + F.col("before")).alias("start"))


def mix_sources(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, total_tokens: float | None = None, tilt: float = TILT) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, use_no, n_tokens, position, range-sorted by position) and the report per target source.

    A document is taken where its middle token is still wanted, so a source is off by at most half a
    document. Documents without tokens or of no target source are not used. The targets table has
    one row per source; it and the per-source totals are what comes to the driver.
    """
    rows = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()]
    sized = stage(token_counts(documents, tokenizer).filter("n_tokens > 0"), "mix-sizes")
    ours = sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    totals = {r["source"]: (r["t"], r["n"]) for r in ours.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    plans = plan_mix(totals, rows, total_tokens, tilt)
    spark = documents.sparkSession
    plan_rows = [(p.source, float(p.tokens), float(p.wanted), float(p.tilt)) for p in plans]
    plan = F.broadcast(spark.createDataFrame(plan_rows, "source string, tokens double, wanted double, tilt double"))
    buckets = max(1, math.ceil(sum(n for _, n in totals.values()) / BUCKET_DOCS))
    starts = _starts(ours, buckets).join(plan, "source")
    uses = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("wanted") / F.col("tokens")).cast("int") - 1, F.lit(0)))).alias("use")
    at = F.col("use") * F.col("tokens") + F.col("start")
    used = starts.select("*", uses).filter(at + F.col("n_tokens") / 2 < F.col("wanted"))
    mixed = stage(used.select("doc_id", "source", (F.col("use") + 1).alias("use_no"), "n_tokens", position(at / F.col("wanted"), F.col("tilt")).alias("position")), "mix-rows")

    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_uses"), F.max("use_no").alias("most_uses"))
    shown = spark.createDataFrame(
        [(s, float(share) if share is not None else None, reps, totals.get(s, (0, 0))[0], next((p.mix_share for p in plans if p.source == s), 0.0)) for s, share, reps in rows],
        "source string, target_share double, max_repeats int, source_tokens bigint, mix_share double",
    )
    joined = shown.join(got, "source", "left")
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    report = joined.select(
        "source", "target_share", "mix_share", "max_repeats", "source_tokens",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("used_tokens", "n_uses", "most_uses")],
        F.coalesce(F.round(F.col("used_tokens") / total, 6), F.lit(0.0)).alias("actual_share"),
    )
    return mixed.orderBy("position", "source", "doc_id", "use_no"), report
