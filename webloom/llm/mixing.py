"""Sources mixed to target shares of a total size in tokens.

Within a source every record has an exponential key scaled by its quality weight (Efraimidis and
Spirakis); records in the order of their keys are a weighted sample without replacement.  A source first
gets complete epochs, then the records whose running token sum, in key order, fits what is left of its
budget.  The running sum is over key ranges first (one row a range) and over rows only inside the one range
where the budget ends, so no source is ever sorted in one task.  Ranges are of equal width on the logarithm of the key:
a weight only shifts that logarithm, whose density is never above 1/e, so no range holds more than its part of a
source whatever the weights are.
"""

from __future__ import annotations

import base64
import functools
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.scratch import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how this vocabulary cuts text
ROWS_PER_RANGE, VOCABULARY = 20_000, 64_000_000


@functools.lru_cache(2)
def _encoding(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``documents`` with n_tokens in place of text; a null text has none.

    The vocabulary file is read on the driver and sent to all tasks; files above VOCABULARY bytes are refused.
    """
    if os.path.getsize(path) > VOCABULARY:
        raise ValueError(f"{path} is larger than {VOCABULARY} bytes")
    with open(path, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())  # checked above
    keep = [c for c in documents.columns if c not in ("text", "n_tokens")]
    fields = [f for f in documents.schema if f.name in keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("text").fillna("").tolist()
            pdf["n_tokens"] = [len(x) for x in _encoding(shared.value).encode_ordinary_batch(texts, num_threads=1)]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return documents.select(*keep, "text").mapInPandas(count, schema)


def plain_source(name: Column) -> Column:
    """Names of sources differ in case, blanks, underscores and hyphens only."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_\-]+", "-")


def source_targets(targets: DataFrame) -> DataFrame:
    """One row per mix and source: shares added, the strictest cap kept (null: none); shares of null or below 0 count as 0."""
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    return targets.where("mix is not null and source is not null").groupBy("mix", plain_source(F.col("source")).alias("source")).agg(F.sum(F.when(~F.isnan(share), share).otherwise(0.0)).alias("share"), F.min("max_repeats").alias("cap"))


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, keep_shares: bool = True) -> DataFrame:
    """Budget of each source of each mix: mix, source, share (of one), cap, size, n, budget, epochs, rest.

    sizes: source, size, n.  Shares are scaled to one over the sources there are.  A mix is as large as ``total``, or as
    the corpus.  Where caps don't allow that at the target shares, ``keep_shares`` makes the mix as much smaller as all
    shares need, which one small capped source can make a lot; without it the size is kept and sources at
    their cap fall short.  A ``total`` given is never lessened.  The report shows either loss.
    """
    met = source_targets(targets).join(sizes, "source", "left").withColumn("there", F.coalesce(F.col("size") > 0, F.lit(False)) & (F.col("share") > 0) & F.coalesce(F.col("cap") > 0, F.lit(True)))
    by = Window.partitionBy("mix")  # one row a source
    met = met.withColumn("goal", F.when(F.col("there"), F.col("share") / F.sum(F.when(F.col("there"), F.col("share"))).over(by)).otherwise(0.0))
    corpus = sizes.agg(F.sum("size").alias("corpus"))
    room = F.min(F.when(F.col("there"), F.col("cap") * F.col("size") / F.col("goal"))).over(by)
    met = met.crossJoin(F.broadcast(corpus))  # one row
    met = met.withColumn("total", F.lit(float(total)) if total else F.least(F.col("corpus").cast("double"), F.coalesce(room, F.col("corpus").cast("double"))) if keep_shares else F.col("corpus").cast("double"))
    want = F.col("goal") * F.col("total")
    met = met.withColumn("budget", F.when(F.col("there"), F.least(want, F.coalesce(F.col("cap") * F.col("size"), want))).otherwise(0.0))
    met = met.withColumn("epochs", F.when(F.col("there"), F.floor(F.col("budget") / F.col("size") + 1e-9)).otherwise(F.lit(0)).cast("int"))
    return met.withColumn("rest", F.when(F.col("there"), F.greatest(F.col("budget") - F.col("epochs") * F.col("size"), F.lit(0.0))).otherwise(0.0))


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, rows_per_range: int = ROWS_PER_RANGE, keep_shares: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, report): how often each record appears in each mix, and the shares reached.

    documents: doc_id, source, n_tokens, weight (null or not above 0: 1e-6).  rows: mix, doc_id, source, n_tokens,
    copies.  report: mix, source, target_share, max_repeats, tokens, actual_share, most_copies, and full_tokens, what the
    source's share of the whole corpus (or of ``total``) would be.  ``keep_shares``: see ``mix_plan``.  Records without
    tokens never appear; ties of keys go to the smaller doc_id; sources without records are reported with 0.
    """
    scratch = Scratch(documents.sparkSession)
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-6)
    docs = documents.where("doc_id is not null and source is not null and n_tokens > 0").select("doc_id", plain_source(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"), (-F.log(unit) / weight).alias("key"))
    docs = scratch.cut(docs, "docs")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n"))
    plan = scratch.cut(mix_plan(sizes, targets, total, keep_shares), "plan")
    used = plan.where("budget > 0").select("mix", "source", "epochs", "rest", F.greatest(F.ceil(F.col("n") / (math.e * rows_per_range)), F.lit(1)).alias("ranges"))
    each = docs.join(used, "source").withColumn("range", F.floor(F.log("key") * F.col("ranges")))
    parts = each.groupBy("mix", "source", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("mix", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = scratch.cut(parts.withColumn("before", F.coalesce(before, F.lit(0))), "ranges")
    each = each.join(parts, ["mix", "source", "range"])
    rest, end = F.col("rest"), F.col("before") + F.col("in_range")
    whole = each.where((end <= rest) | (F.col("before") >= rest)).withColumn("extra", (end <= rest).cast("int"))
    edge = each.where((end > rest) & (F.col("before") < rest))
    running = F.sum("n_tokens").over(Window.partitionBy("mix", "source", "range").orderBy("key", "doc_id"))
    edge = edge.withColumn("extra", (F.col("before") + running - F.col("n_tokens") / 2 <= rest).cast("int"))  # nearest to the budget
    rows = whole.unionByName(edge).select("mix", "doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("copies")).where("copies > 0")
    rows = scratch.cut(rows, "rows")
    done = rows.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    report = plan.select("mix", "source", F.col("goal").alias("target_share"), F.col("cap").alias("max_repeats"), F.round(F.col("goal") * (F.lit(float(total)) if total else F.col("corpus"))).cast("long").alias("full_tokens")).join(done, ["mix", "source"], "left")
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    share = F.coalesce(F.try_divide(tokens.cast("double"), F.sum(tokens).over(Window.partitionBy("mix"))), F.lit(0.0))
    return rows, report.select("mix", "source", "target_share", "max_repeats", tokens.alias("tokens"), share.alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "full_tokens")
