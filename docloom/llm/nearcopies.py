"""Problem 5: near-duplicate records by ProbMinHash, banding and verification."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import broadcast_checked, cut_lineage, read_table

WORDS = re.compile(r"[^\W_]+")

#: Arrivals of one element that are drawn at a time.
_CHUNK = 16


class _Codes(dict):
    """64-bit hash of a word, computed once while the worker remembers it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:  # a memory bound; the codes are the same after it
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


@dataclass(frozen=True)
class Bands:
    """``bands`` keys of ``rows`` components each, and a sketch of one bit from each of ``bits`` more.

    A pair of probability Jaccard similarity p shares a key with probability 1 - (1 - p^rows)^bands; the
    default misses 0.0009 at p = 0.75 and 2e-5 at 0.8. A pair's probability Jaccard is mostly about
    its weighted Jaccard similarity or more. Of the sketch bits a share of (1 + p) / 2 agrees;
    ``least_bits`` lies 4 standard deviations below that for p = 0.75. Fewer components a key mean
    fewer keys to shuffle and more pairs to compare; a pair is compared where it meets, by the sketches
    that travel with the keys, so only likely pairs leave the join. Those are compared once more, with
    a bit of each of the first ``bits`` components of the keys besides: ``least_both`` of twice as many
    bits lie 4 standard deviations below the share for p = 0.75 as well.
    """

    rows: int = 6
    bands: int = 36
    bits: int = 128
    least_bits: int = 97
    least_both: int = 202

    def __post_init__(self) -> None:
        if self.bands > 64 or self.bits != 128 or self.rows * self.bands < self.bits:
            raise ValueError("at most 64 bands, a sketch of 128 bits, and as many components of keys")

    @property
    def size(self) -> int:
        return self.rows * self.bands + self.bits


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _arrivals(hashes: np.ndarray, first: int, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps and components of the arrivals ``first`` .. ``first + n - 1`` of each element's unit-rate Poisson process."""
    seeds = _mix(hashes[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    gaps = -np.log((seeds >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
    return gaps, (_mix(seeds) % np.uint64(size)).astype(np.int32)


def prob_minhash(docs: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Signatures (one row a document) of weighted sets of 64-bit element hashes.

    Element d of weight w arrives at the times of a Poisson process of rate w, each time at a random
    component; a component keeps its earliest element, so it holds d with a probability
    proportional to w, and two documents agree in it with their probability Jaccard similarity.
    An element whose next arrival comes after the latest time held by any component can change
    nothing more and stops. Documents without elements have a signature of zeros.
    """
    sizes = np.array([len(h) for h, _ in docs], dtype=np.int64)
    out = np.zeros((len(docs), size), dtype=np.uint64)
    if not sizes.sum():
        return out
    hashes, inverse = np.unique(np.concatenate([h for h, _ in docs]), return_inverse=True)
    rate = np.concatenate([w for _, w in docs]).astype(np.float64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    best = np.full(len(docs) * size, np.inf)
    held = np.zeros(len(docs) * size, dtype=np.uint64)
    clock = np.zeros(len(inverse))
    alive, first = np.arange(len(inverse)), 0
    while len(alive):
        used, where = np.unique(inverse[alive], return_inverse=True)
        gaps, component = _arrivals(hashes[used], first, _CHUNK, size)
        times = np.cumsum(gaps, axis=1)[where]
        times /= rate[alive][:, None]
        times += clock[alive][:, None]
        slot = (owner[alive][:, None] * size + component[where]).ravel()
        flat = times.ravel()
        early = flat < best[slot]
        slot, flat = slot[early], flat[early]
        np.minimum.at(best, slot, flat)
        won = flat == best[slot]
        held[slot[won]] = hashes[inverse[alive]].repeat(_CHUNK)[early][won]
        clock[alive] = times[:, -1]
        latest = best.reshape(len(docs), size).max(axis=1)
        alive = alive[clock[alive] < latest[owner[alive]]]
        first += _CHUNK
    has = sizes > 0
    out[has] = held.reshape(len(docs), size)[has]
    return out


def _signed(rows: DataFrame, bands: Bands) -> DataFrame:
    """id, version, n (words), bag (64-bit hash of the word multiset), sketch halves s0 and s1, further bits f0 and f1, and band keys of each row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low : low + 500]
                docs, bags = [], []
                for value in part["text"]:
                    bag = np.array([codes[w] for w in WORDS.findall(value.lower())], dtype=np.uint64)
                    bag.sort()
                    bags.append(xxhash.xxh3_64_intdigest(bag.tobytes()))
                    docs.append(np.unique(bag, return_counts=True))
                signature = prob_minhash(docs, bands.size)
                grouped = signature[:, : bands.rows * bands.bands].reshape(len(docs), bands.bands, bands.rows)
                mixed = np.zeros((len(docs), bands.bands), dtype=np.uint64)
                for r in range(bands.rows):
                    mixed = _mix(mixed ^ grouped[:, :, r])
                one_bit = (_mix(signature) & np.uint64(1)).astype(np.uint8)
                sketch = np.packbits(one_bit[:, bands.rows * bands.bands :], axis=1).view(np.int64)
                further = np.packbits(one_bit[:, : bands.bits], axis=1).view(np.int64)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "version": part["version"].to_numpy(),
                        "n": [int(c.sum()) for _, c in docs],
                        "bag": np.array(bags, dtype=np.uint64).view(np.int64),
                        "s0": sketch[:, 0],
                        "s1": sketch[:, 1],
                        "f0": further[:, 0],
                        "f1": further[:, 1],
                        "keys": list((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    }
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(sign, f"id {kind}, version long, n int, bag long, s0 long, s1 long, f0 long, f1 long, keys array<int>")


def _shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum over words of the smaller count by the sum of the larger."""
    out = []
    counted = lru_cache(4096)(lambda t: Counter(WORDS.findall(t.lower())))
    for x, y in zip(a, b):
        p, q = counted(x), counted(y)
        shared = sum(min(n, q[w]) for w, n in p.items() if w in q)
        out.append(shared / max(1, p.total() + q.total() - shared))
    return pd.Series(out, dtype="float64")


# said to be nondeterministic so that a filter on its result does not compute it a second time
_similarity = F.pandas_udf(_shared_words, T.DoubleType()).asNondeterministic()


def near_pairs(df: DataFrame, id_col: str, text: Column, threshold: float = 0.75, bands: Bands = Bands()) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the texts whose multiset Jaccard similarity of words is at least ``threshold``.

    ``members`` (id, rep) maps each id to the smallest id of the texts with the same words (as a
    multiset); ``pairs`` (rep_a, rep_b, similarity) with rep_a < rep_b holds every verified link
    between different representatives. Copies are compared once and never expanded into pairs here.
    Repeated rows of an id count once (if their texts differ, one is chosen by its hash). Null ids
    and texts without a word are left out of both results; an empty table gives empty results.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).where(F.col("id").isNotNull()).withColumn("version", F.xxhash64("text"))
    signed = cut_lineage(_signed(rows, bands).where("n > 0"))
    bits = F.struct("s0", "s1", "f0", "f1").alias("bits")
    chosen = signed.groupBy("id").agg(F.min_by(F.struct("version", "bag", bits), "version").alias("c")).select("id", "c.*")
    # the smallest id of each bag by partial aggregation, so a bag with a third of all rows is no hot group
    smallest = chosen.groupBy("bag").agg(F.min_by(F.struct("id", "version", "bits"), "id").alias("r")).select("bag", F.col("r.id").alias("rep"), "r.version", "r.bits")
    members = chosen.select("id", "bag").join(smallest.select("bag", "rep"), "bag").select("id", "rep")
    # one row a bag; the links are found between bags, which have the ids of their representatives later
    bags = signed.groupBy("bag").agg(F.first("n").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("keys").alias("keys"))
    # band, key and number of words share a long: rows of 32 bytes are shuffled; a key with many bags is one that AQE splits
    size = F.least("n", F.lit((1 << 26) - 1)).cast("long")
    packed = F.shiftleft(F.col("band").cast("long"), 58).bitwiseOR(F.shiftleft(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 26)).bitwiseOR(size)
    keyed = bags.select("bag", "n", "s0", "s1", F.posexplode("keys").alias("band", "key")).select(packed.alias("packed"), "bag", "s0", "s1")
    words = lambda x: F.col(f"{x}.packed").bitwiseAND(F.lit((1 << 26) - 1))
    sized = F.least(words("a"), words("b")) >= F.lit(threshold) * F.greatest(words("a"), words("b"))
    agree = F.lit(bands.bits) - sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in ("s0", "s1")), F.lit(0))
    met = (F.shiftright("a.packed", 26) == F.shiftright("b.packed", 26)) & (F.col("a.bag") < F.col("b.bag")) & sized & (agree >= bands.least_bits)
    candidates = keyed.alias("a").join(keyed.alias("b"), met).select(F.col("a.bag").alias("bag_a"), F.col("b.bag").alias("bag_b")).distinct()
    side = lambda x: smallest.select(*[F.col(c).alias(f"{c}_{x}") for c in smallest.columns])
    both = candidates.join(side("a"), "bag_a").join(side("b"), "bag_b")
    apart = sum((F.bit_count(F.col(f"bits_a.{c}").bitwiseXOR(F.col(f"bits_b.{c}"))) for c in ("s0", "s1", "f0", "f1")), F.lit(0))
    swap = F.col("rep_a") > F.col("rep_b")
    ordered = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("rep", "version")]
    likely = cut_lineage(both.where(2 * bands.bits - apart >= bands.least_both).select(*ordered))
    wanted = likely.select(F.col("rep_a").alias("id"), F.col("version_a").alias("version")).union(likely.select("rep_b", "version_b")).distinct()
    texts = rows.join(broadcast_checked(wanted), ["id", "version"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    verified = likely.join(texts.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(texts.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
    pairs = verified.select("rep_a", "rep_b", _similarity("text_a", "text_b").alias("similarity")).where(F.col("similarity") >= threshold)
    return pairs, members


def record_text() -> Column:
    """Instruction, context and expected output of a record taken together."""
    return F.concat_ws("\n", "instruction", "context", "expected_output")


def near_groups(pairs: DataFrame, members: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, rep, group_id, links): connected groups over the verified links, and the links of each representative.

    Minimum labels spread over the links with pointer jumping, and lineage is cut each round; the
    rounds end when no label changes. All steps are joins and aggregations; nothing is collected.
    """
    edges = cut_lineage(pairs.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).union(pairs.select("rep_b", "rep_a")))
    labels = cut_lineage(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        new = labels.join(near, "x").select("x", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("x").alias("label"), F.col("label").alias("far"))
        nxt = cut_lineage(new.join(jump, "label", "left").select("x", F.coalesce("far", "label").alias("label"), "old"))
        changed = nxt.where("label <> old").limit(1).count()
        labels = nxt.select("x", "label")
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; raise rounds")
    links = edges.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    per_rep = labels.join(links, "x").select(F.col("x").alias("rep"), F.col("label").alias("group_id"), "links")
    out = members.join(per_rep, "rep", "left")
    return out.select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: its class representative, its group, and the links of its class."""
    return near_groups(*near_pairs(read_table(spark, sf_dir, "records"), "record_id", record_text()))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records with a similarity of at least 0.75, copies included."""
    pairs, members = near_pairs(read_table(spark, sf_dir, "records"), "record_id", record_text())
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    within = a.join(b.withColumnRenamed("rep_b", "rep_a"), "rep_a").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))


P5_FOUND_SQL = r"""
WITH r AS (SELECT record_id, min(concat_ws(chr(10), instruction, context, expected_output)) AS t FROM records GROUP BY record_id),
w AS (SELECT record_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS word FROM r),
c AS (SELECT record_id, word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT record_id, sum(n) AS total FROM c GROUP BY ALL),
m AS (SELECT a.record_id AS x, b.record_id AS y, sum(least(a.n, b.n)) AS same FROM c a JOIN c b ON a.word = b.word AND a.record_id < b.record_id GROUP BY ALL)
SELECT x AS record_id_a, y AS record_id_b FROM m JOIN s p ON p.record_id = x JOIN s q ON q.record_id = y WHERE same / (p.total + q.total - same) >= 0.75
"""

P5_GROUPS_SQL = r"""
WITH RECURSIVE r AS (SELECT record_id, min(concat_ws(chr(10), instruction, context, expected_output)) AS t FROM records GROUP BY record_id),
b AS (SELECT record_id, list_sort(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS bag FROM r),
m AS (SELECT record_id, min(record_id) OVER (PARTITION BY bag) AS rep FROM b WHERE len(bag) > 0),
w AS (SELECT record_id, unnest(bag) AS word FROM b WHERE record_id IN (SELECT rep FROM m)),
c AS (SELECT record_id, word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT record_id, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT a.record_id AS x, b.record_id AS y, sum(least(a.n, b.n)) AS same FROM c a JOIN c b ON a.word = b.word AND a.record_id <> b.record_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN s u ON u.record_id = x JOIN s v ON v.record_id = y WHERE same / (u.total + v.total - same) >= 0.75),
reach AS (SELECT DISTINCT rep AS x, rep AS y FROM m UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT m.record_id AS id, rep, (SELECT min(y) FROM reach WHERE reach.x = rep) AS group_id, (SELECT count(*) FROM e WHERE e.x = rep) AS links FROM m
"""
