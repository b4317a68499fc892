"""How texts end: the shape of a text's last line, judged against how lines of the corpus begin and end.

Whether a text stops inside a sentence cannot be told from punctuation alone, since complete texts
also end with list items, table rows, code, signatures or closing phrases. The corpus tells them
apart: lines that begin like sentences that end with a full stop elsewhere are sentences, and words
that something follows elsewhere are whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

# What may follow a cut (blanks, a broken character, omission marks, also in brackets).
_BLANKS = " \t\n\x0b\f\r"
_AFTER = _BLANKS + "\uFFFD\u2026."
_BRACKETED = r"^[\s\x{FFFD}\x{2026}]*+(?:\]\s*+(?:\x{2026}|\.{3})\s*+\[|\)\s*+(?:\x{2026}|\.{3})\s*+\()"
_CLOSING = "\"'\u201D\u2019\u00BB)]"
_CLOSERS = "[\"'\\u201D\\u2019\\u00BB)\\]]*"
_STOPS = ".!?\u3002"
TERMINAL = f"[.!?\\u3002]{_CLOSERS}$"
_INNER_STOP = f"[\\p{{L}}\\p{{N}})\\u201D\\u2019\"%\\u00B0][.!?]{_CLOSERS}\\s+\\S"
_LIST = r"^\s*(?:[-*\x{2022}\x{2013}\x{25E6}]|\d{1,2}[.)]|[a-z]\))\s"
_VALUE = r"^\s*(?=\S*\d)[\p{Lu}\d][\p{Lu}\d.\-/]*[\p{Lu}\d]\s*$"
_CODE = r"^\s*[\w.]+\([^\n]*$|[;{}]\s*$"

# the same kinds of line in Python, for the statistics over all lines
_PY_LIST = re.compile("\\s*(?:[-*\u2022\u2013\u25E6]|\\d{1,2}[.)]|[a-z]\\))\\s", re.ASCII)
_PY_CALL = re.compile(r"\s*[\w.]+\(", re.ASCII)
_PY_INNER = re.compile("(?:[^\\W_]|[)\u201D\u2019\"%\u00B0])[.!?][\"'\u201D\u2019\u00BB)\\]]*\\s+\\S")
_PY_HEAD = re.compile(r"(?:\S+\s+){3}")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\x0b\f]+")
_OPENING = re.compile(r"[\W_]*([^\W_]+)(?:[\W_]+([^\W_]+))?")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")


def _line_kind(line: Column) -> Column:
    return (
        F.when(F.trim(line) == "", "empty")
        .when(line.rlike(_LIST), "list")
        .when(line.contains("|"), "table")
        .when(line.rlike(_CODE), "code")
        .when(line.rlike(_VALUE), "value")
        .when(line.rlike(TERMINAL), "terminal")
        .when(line.rlike(r"^(?:\S+\s+){3,}?[^\n]*?" + _INNER_STOP), "tail")
        .otherwise("fragment")
    )


def _shape(line: Column) -> Column:
    """Lower-case words of a line with every digit as 0."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ending_features(df: DataFrame, id_col: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, marked, body_chars, body_bytes, kind, first1, first2, n_words, last_word, balanced, stray and line_chars of each text.

    The body is the text without omission marks, a broken character or blanks after it; kind and the
    words are those of its last line. Null texts count as empty.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *keep)
    # read from the end, so that only what follows the body is looked at; one or two dots belong to it
    marks = base.withColumn("bracket", F.regexp_extract(F.reverse("t"), _BRACKETED, 0)).withColumn("rest", F.left("t", F.length("t") - F.length("bracket")))
    marks = marks.withColumn("core", F.rtrim("rest", F.lit(_AFTER)))
    dots = F.regexp_extract(F.substring("rest", F.length("core") + 1, F.lit(3)), r"^\.{1,2}(?!\.)", 0)
    body = marks.withColumn("body", F.concat("core", dots))
    after = F.concat(F.substring("rest", F.length("body") + 1, F.length("rest")), F.col("bracket"))
    body = body.withColumn("line", F.substring_index("body", "\n", -1)).withColumn("w", _shape(F.col("line")))
    return body.select(
        "id",
        *keep,
        after.rlike(r"[\x{FFFD}\x{2026}]|\.{3}").alias("marked"),
        F.length("body").alias("body_chars"),
        F.octet_length("body").alias("body_bytes"),
        _line_kind(F.col("line")).alias("kind"),
        F.get("w", F.lit(0)).alias("first1"),
        F.array_join(F.slice("w", 1, 2), " ").alias("first2"),
        F.size("w").alias("n_words"),
        F.element_at("w", F.when(F.size("w") > 0, -1)).alias("last_word"),
        (F.length(F.regexp_replace("line", r"[^(\[{]", "")) == F.length(F.regexp_replace("line", r"[^)\]}]", ""))).alias("balanced"),
        F.col("line").rlike(r"\|\s*$").alias("stray"),
        F.length(F.col("line")).alias("line_chars"),
    )


def plain_line(line: str) -> bool | None:
    """True for a line that ends like a sentence, False for one that could but does not, None for lists, tables, code, values and the like."""
    if not (bare := line.strip()) or "|" in line or _PY_LIST.match(line) or bare[-1] in ";{}" or "(" in line and _PY_CALL.match(line):
        return None
    if " " not in bare and any(c.isdigit() for c in bare) and len(bare) > 1 and bare[0].isalnum() and bare[-1].isalnum() and all(c.isdigit() or c.isupper() or c in ".-/" for c in bare):
        return None
    if line.rstrip(_CLOSING)[-1:] in _STOPS and line[-1] in _STOPS + _CLOSING:
        return True
    head = _PY_HEAD.match(line)
    return None if head and _PY_INNER.search(line, head.end()) else False


def count_lines(texts: list[str], openings: tuple[Counter, Counter], words: Counter) -> None:
    """Adds the lines and sentences of ``texts`` to the counters: openings that end with a full stop and without one, and words that something follows."""
    ended, open_ = openings
    for text in texts:
        pieces: list[str] = []
        for line in text.split("\n"):
            parts = _SENTENCE.split(line)
            own = parts[:1]
            for part in parts[1:]:
                if part[:1].isupper() or part[:1] == "\u00BF":
                    own.append(part)
                else:
                    own[-1] += " " + part
            pieces += own
        low = _DIGIT.sub("0", text.lower())
        said = _WORD.findall(low)
        last = len(pieces) - 1
        closed = False
        for at, piece in enumerate(pieces):
            ends = plain_line(piece)
            if at == last:
                closed = ends is True
            if ends is None or not (m := _OPENING.match(piece)):
                continue
            if at < last or ends or len(_WORD.findall(piece)) <= 4:
                one, two = m.groups()
                into = ended if ends else open_
                one = _DIGIT.sub("0", one.lower())
                into[one] += 1
                if two:
                    into[f"{one} {_DIGIT.sub('0', two.lower())}"] += 1
        words.update(said if closed else said[:-1])


def line_statistics(texts: DataFrame, text: str, least: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, firsts, whole) counted over all lines of all texts.

    pairs (first2, e2, o2): lines that begin with the two words and end with a full stop, or without
    one. firsts (first1, e1, o1, ep): the same for the first word, and as ep how often such lines begin
    with a word that has first1 as a proper prefix. whole (last_word, n_end): words that something
    follows, so that no cut made them. Openings seen fewer than ``least`` times and words seen once
    are no evidence and are left out. Lines are counted inside each task first, so one shuffle of
    about the distinct keys of a task is all that leaves it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        openings, words = (Counter(), Counter()), Counter()

        def out() -> Iterator[pd.DataFrame]:
            ended, open_ = openings
            keys = list({*ended, *open_})
            yield pd.DataFrame({"role": "opening", "key": pd.Series(keys, dtype=object), "ended": [ended[k] for k in keys], "open": [open_[k] for k in keys]})
            keys = [k for k in words if "0" not in k]
            yield pd.DataFrame({"role": "word", "key": pd.Series(keys, dtype=object), "ended": 0, "open": [words[k] for k in keys]})

        for batch in batches:
            count_lines(batch["t"].tolist(), openings, words)
            if sum(map(len, (*openings, words))) > 400_000:  # a bound of memory: counts are summed below
                yield from out()
                for counter in (*openings, words):
                    counter.clear()
        yield from out()

    # stored since each part is read more than once and small beside the lines
    rows = texts.where(F.length(text) > 0).select(F.col(text).alias("t")).mapInPandas(count, "role string, key string, ended long, open long")
    counted = rows.groupBy("role", "key").agg(F.sum("ended").alias("ended"), F.sum("open").alias("open"))
    counted = cut_lineage(counted.where(F.col("ended") + F.col("open") >= 2))
    starts = counted.where((F.col("role") == "opening") & (F.col("ended") + F.col("open") >= least)).select("key", "ended", "open")
    single = starts.where(~F.col("key").contains(" ") & (F.col("ended") > F.col("open")))
    prefixes = single.where(F.length("key") > 1).select("ended", F.explode(F.expr("transform(sequence(1, length(key) - 1), i -> substring(key, 1, i))")).alias("key")).groupBy("key").agg(F.sum("ended").alias("ep"))
    is_pair = F.col("key").contains(" ")
    pairs = starts.where(is_pair).select(F.col("key").alias("first2"), F.col("ended").alias("e2"), F.col("open").alias("o2"))
    ones = starts.where(~is_pair).select("key", F.col("ended").alias("e1"), F.col("open").alias("o1"), F.lit(None).cast("long").alias("ep"))
    null = F.lit(None).cast("long")
    firsts = ones.union(prefixes.select("key", null, null, "ep")).groupBy(F.col("key").alias("first1")).agg(*[F.max(c).alias(c) for c in ("e1", "o1", "ep")])
    whole = counted.where("role = 'word'").select(F.col("key").alias("last_word"), F.col("open").alias("n_end"))
    return pairs, firsts, whole


def incomplete(features: DataFrame, statistics: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``features`` with score: how surely the text ends inside a word or a sentence (0 to 1)."""
    pairs, firsts, whole = statistics
    joined = features.join(pairs, "first2", "left").join(firsts, "first1", "left").join(whole, "last_word", "left")
    ratio = lambda e, o: F.col(e) / (F.col(e) + F.col(o))
    fragment = (
        # a pair that is never followed through may be the same cut met again, if its first word begins sentences only
        F.when(F.col("e2").isNotNull() & (F.col("n_words") > 1) & ~((F.col("e2") == 0) & (ratio("e1", "o1") >= 0.9)), ratio("e2", "o2"))
        .when(F.col("e1").isNotNull(), ratio("e1", "o1"))
        .when((F.col("n_words") == 1) & F.col("ep").isNotNull(), 0.8)
        .otherwise(F.when((F.col("n_words") >= 6) & (F.col("line_chars") >= 40), 0.8).otherwise(0.0))
    )
    item = F.when(F.col("last_word").rlike("0"), 0.1).when(F.col("n_end").isNotNull(), 0.0).otherwise(0.8)
    score = (
        F.when(F.col("kind") == "tail", 1.0)
        .when(F.col("kind") == "fragment", fragment)
        .when(F.col("kind") == "list", item)
        .when(F.col("kind") == "code", F.when(F.col("balanced"), 0.0).otherwise(0.9))
        .when(F.col("kind") == "table", F.when(F.col("stray"), 0.9).otherwise(0.1))
        .otherwise(0.0)
    )
    # an omission mark or a broken character after an ending that is open anyway makes it surer
    surer = F.when(F.col("marked") & (score >= 0.5), 1 - (1 - score) / 4).otherwise(score)
    return joined.withColumn("score", surer)
