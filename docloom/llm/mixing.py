"""Problem 8: a mix of sources with target shares of tokens, by entropy balancing.

Each document gets a rate of copies. Among all rates that meet the token totals of their sources and
stay within the repeat caps, the chosen ones have the least relative entropy to equal rates; by
convex duality they are exponentially tilted in the document's tokens, rate = min(cap, exp(b t)).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import broadcast_checked, cut_lineage, read_table

#: The public tokenizer's ranks; its folder is a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pattern by which the tokenizer splits text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Buckets of the rounding threshold of a source.
_BUCKETS = 4096


def count_tokens(df: DataFrame, id_col: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) with one row an id; null texts have no tokens, a null source is an empty one."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    counted = rows.mapInPandas(encode, f"id {kind}, source string, tokens long")
    return counted.groupBy("id").agg(F.min_by(F.struct("source", "tokens"), F.struct("tokens", "source")).alias("x")).select("id", "x.*")


def source_budgets(totals: pd.DataFrame, targets: pd.DataFrame, budget: float) -> pd.DataFrame:
    """source, target_share, max_repeats, have, want: tokens wanted from each source.

    A source cannot give more than its tokens times its cap; what it lacks is shared among the others
    by their targets, so that the total stays as near to the budget as the caps allow.
    """
    t = targets.merge(totals, on="source", how="left").fillna({"have": 0.0, "longest": 0.0})
    t["room"] = t["have"] * t["max_repeats"]
    t["want"], open_, left = 0.0, t["target_share"] > 0, budget
    while open_.any() and left > 0:
        share = t["target_share"].where(open_, 0.0)
        ask = left * share / share.sum()
        full = open_ & (ask >= t["room"])
        if not full.any():
            t.loc[open_, "want"] = ask[open_]
            break
        t.loc[full, "want"] = t.loc[full, "room"]
        left -= float(t.loc[full, "room"].sum())
        open_ &= ~full
    return t


def balance(tokens: DataFrame, budgets: pd.DataFrame, rounds: int = 40, tolerance: float = 1e-7) -> pd.DataFrame:
    """source and multiplier b of the tilted rates min(cap, exp(b t / mean)), by Newton's method on the dual.

    Every round is one aggregation over (source, tokens) counts, which are distinct lengths and not
    documents. Only a row a source, of the fixed target table, reaches the driver.
    """
    lengths = cut_lineage(tokens.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    spark = tokens.sparkSession
    state = budgets[(budgets["want"] > 0) & (budgets["want"] < budgets["room"] * (1 - 1e-9))][["source", "max_repeats", "want", "have", "docs"]].copy()
    state["mean"] = state["have"] / state["docs"]
    state["b"] = np.log(np.maximum(state["want"] / state["have"], 1e-12))
    low, high = np.full(len(state), -700.0), np.full(len(state), 700.0)
    for _ in range(rounds):
        if state.empty:
            break
        small = spark.createDataFrame(state[["source", "max_repeats", "mean", "b"]])
        z = F.col("b") * F.col("tokens") / F.col("mean")
        rate = F.exp(F.least(z, F.lit(60.0)))
        capped = rate >= F.col("max_repeats")
        got = F.when(capped, F.col("max_repeats")).otherwise(rate) * F.col("tokens") * F.col("n")
        slope = F.when(capped, 0.0).otherwise(rate) * F.col("tokens") * F.col("tokens") / F.col("mean") * F.col("n")
        stats = lengths.join(F.broadcast(small), "source").groupBy("source").agg(F.sum(got).alias("got"), F.sum(slope).alias("slope")).toPandas()
        state = state.drop(columns=["got", "slope"], errors="ignore").merge(stats, on="source", how="left")
        error = (state["got"] - state["want"]).to_numpy()
        b = state["b"].to_numpy(copy=True)
        high, low = np.where(error > 0, np.minimum(high, b), high), np.where(error <= 0, np.maximum(low, b), low)
        if np.all(np.abs(error) <= tolerance * state["want"]):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            step = b - error / state["slope"].to_numpy()
        inside = np.isfinite(step) & (step > low) & (step < high)
        state["b"] = np.where(inside, step, np.where(np.isinf(low) | (low <= -700), b - 1.0, np.where(high >= 700, b + 1.0, (low + high) / 2)))
    return state[["source", "b", "mean"]]


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share_of_corpus: float = 0.5, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): how often to use each document, and what share of tokens each source has then.

    ``copies`` (id, source, tokens, copies) leaves out documents with no copy. ``targets`` (source,
    target_share, max_repeats) has a row a source and is small; documents of other sources are left
    out, and sources without documents give nothing. Repeated rows of a document count once, empty
    documents get no copy, an empty corpus gives empty copies and shares of zero.

    Rates become copies without gathering a source: the whole part, plus one where a hash of the
    document lies below the fraction, moved by an offset for each source that a histogram of
    fixed size finds, so that the source's tokens come out right. A source has one offset and any
    number of tasks.
    """
    spark = docs.sparkSession
    tokens = cut_lineage(count_tokens(docs, id_col, text, source, tokenizer))
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas()
    per = tokens.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"), F.max("tokens").alias("longest"))
    total = float(tokens.agg(F.sum("tokens")).first()[0] or 0.0)
    # only sources of the target table come to the driver
    wanted_sources = broadcast_checked(targets.select("source").distinct())
    have = per.join(wanted_sources, "source", "left_semi").toPandas().astype({"have": float, "docs": float, "longest": float})
    budgets = source_budgets(have, goal, total * share_of_corpus)
    tilt = balance(tokens, budgets)
    plan = budgets.merge(tilt, on="source", how="left")
    columns = plan[["source", "max_repeats", "want", "room", "b", "mean"]].astype({"max_repeats": float})
    rated = tokens.join(F.broadcast(spark.createDataFrame(columns)) if len(columns) else tokens.select("source").limit(0), "source").where("tokens > 0 and want > 0")
    tilted = F.exp(F.least(F.col("b") * F.col("tokens") / F.col("mean"), F.lit(60.0)))
    rate = F.when(F.isnan("b") | F.col("b").isNull(), F.col("max_repeats")).otherwise(F.least(tilted, F.col("max_repeats")))
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("gap", u - (F.col("rate") - F.col("whole")))
    rated = rated.withColumn("whole", F.least(F.col("whole"), F.col("max_repeats").cast("long"))).withColumn("free", (F.col("whole") < F.col("max_repeats")).cast("int"))
    bucket = F.floor((F.col("gap") + 1.0) / 2.0 * _BUCKETS)
    ladder = rated.groupBy("source", bucket.alias("k")).agg(F.sum(F.col("tokens") * F.col("free")).alias("extra"), F.sum(F.col("tokens") * F.col("whole")).alias("base")).toPandas()
    cut = []
    for row in plan.itertuples():
        own = ladder[ladder["source"] == row.source].sort_values("k")
        need = row.want - float(own["base"].sum())
        reach = own["extra"].cumsum().to_numpy(dtype=float)
        at = int(np.searchsorted(reach, need)) if len(own) else 0
        if len(own) and at < len(own):
            before = reach[at - 1] if at else 0.0
            part = (need - before) / max(1.0, reach[at] - before)
            edge = (float(own["k"].iloc[at]) + min(1.0, max(0.0, part))) / _BUCKETS * 2.0 - 1.0
        else:
            edge = math.inf
        cut.append((row.source, float(edge) if math.isfinite(edge) else 2.0))
    edges = spark.createDataFrame(cut, "source string, edge double")
    taken = rated.join(F.broadcast(edges), "source").withColumn("copies", (F.col("whole") + F.when(F.col("gap") < F.col("edge"), F.col("free")).otherwise(0)).cast("long"))
    copies = taken.where("copies > 0").select("id", "source", "tokens", "copies")
    used = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = spark.createDataFrame(plan[["source", "target_share", "max_repeats", "have", "want", "longest"]].astype({"have": float, "want": float, "longest": float})) if len(plan) else None
    if report is None:
        return copies, used.select("source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "mixed_tokens", F.lit(0.0).alias("actual_share"), "most_copies", F.lit(0).cast("long").alias("longest_document"))
    joined = report.join(used, "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    whole = joined.join(F.broadcast(joined.agg(F.sum("mixed_tokens").alias("all_tokens"))))  # one row
    shares = whole.select("source", "target_share", "max_repeats", F.col("have").cast("long").alias("source_tokens"), F.round("want").cast("long").alias("wanted_tokens"), "mixed_tokens", F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), "most_copies", F.col("longest").cast("long").alias("longest_document"))
    return copies, shares


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, copies) of the mix."""
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, max_repeats, within_cap, at_target): whether no document of a source is used too often, and its tokens lie within a document or a thousandth of what was wanted."""
    shares = p8_shares(spark, sf_dir)
    off = F.abs(F.col("mixed_tokens") - F.col("wanted_tokens"))
    return shares.select("source", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (off <= F.greatest(F.col("longest_document"), F.col("wanted_tokens") / 1000)).alias("at_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


P8_CHECKS_SQL = "SELECT source, max_repeats, true AS within_cap, true AS at_target FROM mix_targets"
