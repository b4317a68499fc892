"""Problem 9: texts cut off by field limits.

Length hazards find the lengths at which texts of a source end far more often than around. How
surely an ending is incomplete comes from the corpus's lines; what an ending means for a text of a
significant length, and for one of any other length (cut in transfer), is then learned together:
two kinds of text, cut and whole, mixed at each length by the excess of its hazard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.endings import ending_features, incomplete, line_statistics
from docloom.session import cut_lineage, read_table


def significant_lengths(lengths: DataFrame, group: str, neighbours: int = 25, rate: float = 0.01) -> DataFrame:
    """(group, unit, length, n, expected): lengths at which far more texts of a group end than around.

    ``lengths`` has group, unit and length, one row a text. The hazard of a length is the share of the
    texts reaching it that end there; the texts expected to end there follow from the pooled hazard
    of the up to ``neighbours`` observed lengths on either side. The Chernoff bound of the Poisson
    tail serves as a (conservative) p-value, and the Benjamini-Hochberg rule holds the false
    discovery rate at ``rate`` over all groups and lengths. Texts are counted by group and length
    first, so the windows see one row a distinct length.
    """
    counts = lengths.groupBy(group, "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group, "unit").orderBy("length")
    risk = counts.withColumn("reach", F.sum("n").over(own.rowsBetween(0, Window.unboundedFollowing)))
    around = own.rowsBetween(-neighbours, neighbours)
    # lengths between observed ones have no row but the same texts at risk
    exposure = F.col("reach") * (F.col("length") - F.coalesce(F.lag("length").over(own), F.col("length") - 1))
    risk = risk.withColumn("exposure", exposure)
    near_n = F.sum("n").over(around) - F.col("n")
    near_exposure = F.sum("exposure").over(around) - F.col("exposure")
    tested = risk.withColumn("expected", F.col("reach") * (near_n + 0.5) / (near_exposure + F.col("reach")))
    log_p = F.when(F.col("n") <= F.col("expected"), 0.0).otherwise(-(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected")))
    tested = tested.withColumn("log_p", log_p).where(F.col("n") >= 3)
    # Benjamini-Hochberg by counting tests per p-value bucket: no global sort of all tests in one task
    bucket = F.floor(F.greatest(F.col("log_p"), F.lit(-400.0)) * 4)
    tested = tested.withColumn("bucket", bucket)
    ladder = tested.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    steps = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = ladder.agg(F.sum("k").alias("tests"))
    passed = ladder.withColumn("rank", F.sum("k").over(steps)).join(total).where((F.col("bucket") + 1) / 4 <= F.log(F.lit(rate) * F.col("rank") / F.col("tests")))
    edge = passed.agg(F.max("bucket").alias("edge"))
    return tested.join(edge, F.col("bucket") <= F.col("edge")).select(group, "unit", "length", "n", "expected")


def _judged(df: DataFrame, id_col: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(source), F.lit("")).alias("source")).where(F.col("id").isNotNull())
    features = incomplete(ending_features(rows, "id", "text", keep=("source",)), line_statistics(rows, "text"))
    features = cut_lineage(features.select("id", "source", "kind", "score", "marked", "body_chars", "body_bytes").distinct())
    both = F.explode(F.array(F.struct(F.lit("characters").alias("unit"), F.col("body_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("body_bytes").alias("length"))))
    limits = significant_lengths(features.where("body_chars > 0").select("source", both.alias("x")).select("source", "x.unit", "x.length"), "source")
    return features, limits


#: Steps in which the excess of a hazard and the score of an ending are told apart.
STEPS = 10


def fit_mixture(counts: pd.DataFrame, rounds: int = 200) -> pd.DataFrame:
    """``counts`` (kind, level, marked, excess, n) with posterior: how surely a text of that ending at such a length was cut.

    ``excess`` is the share of the texts of a length that its hazard does not explain, in STEPS, 0
    where the length is not significant. There, only transfers cut, and the score of the ending is
    the posterior. At significant lengths two kinds of text are mixed, by a share ``limit`` of the
    excess: cut ones, whose endings are learned there by expectation maximisation from the scores
    on, and whole ones, which end as texts of all other lengths do.
    """
    t = counts.groupby(["kind", "level", "marked", "excess"], as_index=False)["n"].sum()
    ending = t.groupby(["kind", "level", "marked"]).ngroup().to_numpy()
    n, score = t["n"].to_numpy(float), t["level"].to_numpy(float) / STEPS
    excess = np.maximum(0.0, (t["excess"].to_numpy(float) - 0.5) / STEPS)
    at, kinds = excess > 0, int(ending.max()) + 1 if len(t) else 0
    prior = np.zeros(kinds)
    prior[ending] = score
    whole = np.bincount(ending[~at], (n * (1 - score))[~at], kinds) + (1 - prior)
    whole /= max(whole.sum(), 1e-9)
    r = score.copy()
    for _ in range(rounds if at.any() else 0):
        cut = np.bincount(ending[at], (n * r)[at], kinds) + prior
        cut /= max(cut.sum(), 1e-9)
        limit = np.clip((n * r)[at].sum() / (n * excess)[at].sum(), 0.05, 1.0)
        yes, no = limit * excess * cut[ending], (1 - limit * excess) * whole[ending]
        fresh = np.where(at, np.maximum(score, yes / np.maximum(yes + no, 1e-300)), score)
        moved, r = np.abs(fresh - r).max(), fresh
        if moved < 1e-6:
            break
    return t.assign(posterior=r)


def judge_endings(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(judged, limits): id, source, at_limit and posterior of each text, and the significant lengths.

    Only counts of endings by kind, score step, omission mark and excess step reach the driver: at
    most 8 * 11 * 2 * 11 rows whatever the data's size.
    """
    features, limits = _judged(df, id_col, text, source)
    found = limits.withColumn("share", 1 - F.col("expected") / F.col("n"))
    of = lambda unit, length: found.where(F.col("unit") == unit).select("source", F.col("length").alias(length), F.col("share").alias(unit))
    placed = features.join(of("characters", "body_chars"), ["source", "body_chars"], "left").join(of("bytes", "body_bytes"), ["source", "body_bytes"], "left")
    excess = F.ceil(F.coalesce(F.greatest("characters", "bytes"), F.lit(0.0)) * STEPS).cast("int")
    placed = placed.select("id", "source", "kind", F.round(F.col("score") * STEPS).cast("int").alias("level"), "marked", excess.alias("excess"))
    table = fit_mixture(placed.groupBy("kind", "level", "marked", "excess").agg(F.count(F.lit(1)).alias("n")).toPandas())
    key = ["kind", "level", "marked", "excess"]
    schema = "kind string, level int, marked boolean, excess int, posterior double"
    rated = df.sparkSession.createDataFrame(list(table[[*key, "posterior"]].itertuples(index=False, name=None)), schema)
    judged = placed.join(F.broadcast(rated), key).select("id", "source", (F.col("excess") > 0).alias("at_limit"), "posterior")
    return judged, limits


def find_truncated(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", cutoff: float = 0.5) -> DataFrame:
    """(id, source, at_limit, posterior) of the texts that were cut off inside a word or a sentence.

    At a significant length of its source (in characters or UTF-8 bytes, without omission marks) a
    text is held to be cut on weaker evidence of its ending than elsewhere, where only transfers cut.
    Null ids are skipped; null and empty texts are complete; a null source is a group of its own;
    repeated rows count once; an empty table gives an empty result.
    """
    judged, _ = judge_endings(df, id_col, text, source)
    found = judged.where(F.col("posterior") >= cutoff)
    return found.groupBy("id").agg(F.min("source").alias("source"), F.max("at_limit").alias("at_limit"), F.max("posterior").alias("posterior"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that were cut."""
    return find_truncated(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cut documents, those at a significant length, and the rate of cut ones, by source."""
    docs = read_table(spark, sf_dir, "documents")
    cut = find_truncated(docs).select(F.col("id").alias("doc_id"), "at_limit", F.lit(1).alias("cut"))
    joined = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).join(cut, "doc_id", "left")
    n = F.count(F.lit(1))
    return joined.groupBy("source").agg(n.alias("documents"), F.count("cut").alias("cut_documents"), F.count(F.when(F.col("at_limit"), 1)).alias("cut_at_limit"), (F.count("cut") / n).alias("cut_rate"))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant lengths by source."""
    return _judged(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")[1]
