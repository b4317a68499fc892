"""Problem 2: text decoded with the wrong character encoding, found and restored.

A noisy channel: text was encoded in one charset and decoded in another, wholly or for a span, once
or twice, sometimes losing bytes. Every distinct word with characters beyond ASCII gets a byte
lattice for each channel, in which a lost byte (U+FFFD) is a wildcard: a lead byte that is left, or
the bytes that a charset has no character for, still bound what it can have been. Corpus words that
fit the lattice fill the wildcards. Words are scored by their corpus frequency, with the frequency of
their shape behind it, and Viterbi search over a row's words picks the channel of each, where a
change of channel costs extra. Forms that are garbled themselves are no evidence of a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.lookalikes import TO_LATIN
from docloom.session import broadcast_checked, cut_lineage, read_table, spread_out

LOST = "�"

# Charsets that UTF-8 text is taken for, and (true, taken for) pairs of one-byte charsets.
TAKEN_FOR = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp1254", "mac_latin2", "mac_cyrillic")
ONE_BYTE = (
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp852"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1250", "cp852"), ("cp852", "cp1250"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"), ("cp1250", "cp850"), ("cp1250", "cp437"),
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("iso8859_5", "cp1252"), ("cp1251", "cp1250"),
)

#: Log scores: of a channel that yields valid UTF-8 sequences, of a change to a one-byte channel beside that of any change, of a broken rule of spelling.
VALID_UTF8, REMAPPED, SWITCH, ODD = 3.0, -1.5, -2.0, 5.0
#: Weight of a shape's count beside a word's own.
SHAPE_WEIGHT = 0.01

_LOOK_ALIKES = frozenset(TO_LATIN)
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Java pattern of words with a character beyond ASCII, between ASCII blanks.
TOKEN = r"[^ \t\r\n\x0b\f]*[^\x00-\x7F][^ \t\r\n\x0b\f]*"
_ASCII_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
_EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def _table(charset: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; undefined bytes stand for the control character of their value."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


def _is_undefined(byte: int, charset: str) -> bool:
    try:
        bytes([byte]).decode(charset)
    except UnicodeDecodeError:
        return True
    return False


_TABLES = {c: _table(c) for c in {*TAKEN_FOR, *(seen for _, seen in ONE_BYTE)}}
_CHARS = {c: {b: ch for ch, b in reversed(_table(c).items())} for c in {true for true, _ in ONE_BYTE}}  # a byte's own character, not its control character


#: Bytes that a charset has no character for, and the no-break space, which is lost where blanks are tidied.
_UNDEFINED = {c: frozenset({b for b in range(0x80, 0xC0) if _is_undefined(b, c)} | {0xA0}) for c in TAKEN_FOR}

#: A restored word: its characters, U+FFFD where bytes were lost, and the characters each of those can be ("" for any).
Lattice = tuple[str, list[str]]


def _as_utf8(run: str, charset: str) -> tuple[str, list[str], bool]:
    """``run`` with its UTF-8 sequences decoded, what its lost characters can be, and whether there was any sequence."""
    table = _TABLES[charset]
    data = [None if c == LOST else table.get(c, 0x1A) for c in run]
    if 0x1A in data:
        return run, [""] * run.count(LOST), False
    out, allowed, hit, at = [], [], False, 0
    while at < len(data):
        lead = data[at]
        size = 0 if lead is None else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        rest = data[at + 1 : at + size] if size else []
        if size and len(rest) == size - 1 and all(b is None or 0x80 <= b <= 0xBF for b in rest):
            choices = [[b] if b is not None else range(0x80, 0xC0) for b in rest]
            if rest.count(None) > 1:
                out.append(LOST)
                allowed.append("")
            else:
                chars = []
                for tail in product(*choices):
                    try:
                        chars.append(bytes([lead, *tail]).decode())
                    except UnicodeDecodeError:
                        continue
                out.append(chars[0] if None not in rest and chars else LOST)
                if None in rest or not chars:
                    allowed.append("".join(chars))
            hit = True
            at += size
        elif lead is None and at + 1 < len(data) and data[at + 1] is not None and 0x80 <= data[at + 1] <= 0xBF:
            out.append(LOST)
            allowed.append("".join(chr((b & 0x1F) << 6 | data[at + 1] & 0x3F) for b in range(0xC2, 0xE0)))
            hit = True
            at += 2
        elif run == "\u00C3" and lead == 0xC3:  # a bare lead byte: its no-break space became a blank
            return "\u00E0", [], True
        else:
            out.append(run[at])
            if lead is None:
                allowed.append("")
            at += 1
    return "".join(out), allowed, hit


def candidates(token: str, levels: int = 3) -> list[tuple[str, str, list[str]]]:
    """(channel, word, allowed) for every channel that changes ``token``; allowed has the characters that each wildcard of the word can be."""
    out: dict[str, Lattice] = {}
    for charset in TAKEN_FOR:
        now = token
        for level in range(1, levels + 1):
            allowed: list[str] = []
            hits = False

            def decode(m: re.Match[str], charset: str = charset, allowed: list[str] = allowed) -> str:
                nonlocal hits
                text, own, hit = _as_utf8(m.group(), charset)
                hits |= hit
                allowed += own
                return text

            changed = _RUN.sub(decode, now)
            if not hits or changed == now:
                break
            now = changed
            out[f"utf-8 as {charset} x{level}"] = (now, allowed)
    # look-alike letters among ASCII ones were put there, not decoded
    swapped = any("a" <= c.lower() <= "z" for c in token) and not _LOOK_ALIKES.isdisjoint(token)
    for true, seen in () if swapped else ONE_BYTE:
        table, chars = _TABLES[seen], _CHARS[true]
        inside = "".join(_RUN.findall(token))
        if all(c in table and not c.isspace() for c in inside):
            mapped = _RUN.sub(lambda m: "".join(chars.get(table[c], LOST) for c in m.group()), token)
            if mapped != token and LOST not in mapped:
                out[f"{true} as {seen}"] = (mapped, [])
    if LOST in token:
        out["lost bytes"] = (token, [""] * token.count(LOST))
    return [(channel, word, allowed) for channel, (word, allowed) in out.items()]


_LATIN_RUN = re.compile("[\u00C0-\u024F]{3,}")
_CASE = re.compile("[^\\W\\d_]+")


def oddness(word: str) -> int:
    """How many rules of spelling a word breaks: a capital after a small letter, a mark between letters, accents only, two scripts."""
    letters = _CASE.findall(word)
    inner = word.strip("\u201C\u201D\u2018\u2019\u00AB\u00BB\u201E\u201A\u2026")
    odd = any(a.islower() and b.isupper() for part in letters for a, b in zip(part, part[1:]))
    mark = any(a.isalpha() and b.isalpha() and not m.isalpha() and ord(m) > 0x7F and m not in "\u2019\u2010\u2011\u00AD" for a, m, b in zip(inner, inner[1:], inner[2:]))
    accents = bool(_LATIN_RUN.search(word)) and not re.search("[A-Za-z]", word)
    scripts = len({"C" if "\u0400" <= c <= "\u052F" else "L" for part in letters for c in part}) > 1
    return odd + mark + accents + scripts


def fits(word: str, allowed: list[str], fill: str) -> bool:
    """Whether a corpus word is a path of the lattice."""
    if len(word) != len(fill):
        return False
    lost = iter(allowed)
    for c, f in zip(word, fill):
        if c == LOST:
            own = next(lost, "")
            if f <= "\x7f" or (own and f not in own):
                return False
        elif c != f:
            return False
    return True


#: Weight of a fill whose lost bytes are those that the charset has no character for.
LIKELY = 10


def lost_there(channel: str, word: str, fill: str) -> bool:
    """Whether every wildcard of a UTF-8 channel is filled by a character that loses a byte in its charset."""
    found = re.fullmatch(r"utf-8 as (\w+) x\d", channel)
    return bool(found) and all(not _UNDEFINED[found[1]].isdisjoint(f.encode()[1:]) for c, f in zip(word, fill) if c == LOST)


_BEYOND = re.compile(r"[^\x00-\x7f]")


def fill_keys(word: str, lost: bool) -> list[str]:
    """Keys by which a word with lost characters (``lost``) and the corpus words that can fill it meet.

    Words with ASCII letters meet by those and by where others stand. Words without any are looked up
    by all but one or two of their characters, as whole alphabets would meet under one key otherwise.
    A word of which nothing is left has no key.
    """
    wild = "w" + _BEYOND.sub(LOST, word)
    at = [i for i, c in enumerate(word) if c > "\x7f"]
    if any("a" <= c.lower() <= "z" for c in word) or not 2 <= len(at) <= 16:
        return [wild] if not lost or len(word) == 1 or set(word) != {LOST} else []
    if lost:
        return [] if set(word) == {LOST} else ["s" + word] if word.count(LOST) <= 2 else [wild]
    blank = lambda *gone: "s" + "".join(LOST if i in gone else c for i, c in enumerate(word))
    return [wild, *(blank(i) for i in at), *(blank(i, j) for n, i in enumerate(at) for j in at[n + 1 :])]


def shape(column: F.Column) -> F.Column:
    """A word with runs of ASCII letters and of digits as one character each."""
    return F.regexp_replace(F.regexp_replace(column, "[A-Za-z]+", "a"), "[0-9]+([.,][0-9]+)*", "0")


def _tokens(df: DataFrame) -> DataFrame:
    """(key columns, pos, token) of the words with characters beyond ASCII."""
    found = df.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(*[c for c in df.columns if c != "text"], F.posexplode(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "token"))
    return found.withColumn("token", F.regexp_replace("token", _EDGES, "")).where(F.col("token") != "")


@F.pandas_udf(T.StringType())
def _transplanted(word: pd.Series, model: pd.Series) -> pd.Series:
    """Words with their lost characters taken from the model's characters beyond ASCII, in order; null without a model."""
    out = []
    for w, m in zip(word, model):
        marks = None if m is None else iter(_BEYOND.findall(m))
        out.append(None if marks is None else _BEYOND.sub(lambda c: next(marks, c.group()), w))
    return pd.Series(out, dtype=object)


def token_repairs(tokens: DataFrame) -> DataFrame:
    """(token, own, options): words that some channel explains about as well as they explain themselves.

    ``tokens`` has a row an occurrence; it is aggregated first, so everything here is on the scale of
    the distinct words. ``options`` is an array of (channel, word, score). Words that hold UTF-8
    sequences or lost bytes do not count as evidence, neither for themselves nor as another's
    repair, however many rows were garbled alike.
    """
    counts = cut_lineage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    schema = "token string, channel string, word string, allowed array<string>, odd int, token_odd int"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, c, w, a, oddness(w), own) for t in batch["token"] for own in (oddness(t),) for c, w, a in candidates(t)]
            yield pd.DataFrame(rows, columns=["token", "channel", "word", "allowed", "odd", "token_odd"])

    options = cut_lineage(spread_out(counts.select("token")).mapInPandas(spread, schema).withColumn("bare", F.regexp_replace("word", _EDGES, "")))
    is_utf8 = F.col("channel").startswith("utf-8")
    # a sequence by chance gives letters that the corpus has in no such place; of real ones it has the word or its shape
    every = broadcast_checked(cut_lineage(counts.select(shape(F.col("token")).alias("shape")).distinct()))
    decoded = options.where(is_utf8 & ~F.col("word").contains(LOST)).select("token", "bare")
    seen = decoded.join(counts.select(F.col("token").alias("bare")), "bare", "left_semi").select("token")
    alike = decoded.join(every, shape(F.col("bare")) == F.col("shape"), "left_semi").select("token")
    garbled = seen.union(alike).union(options.where(F.col("token").contains(LOST)).select("token")).distinct()
    clean = cut_lineage(counts.join(garbled, "token", "left_anti"))
    shapes = broadcast_checked(cut_lineage(clean.groupBy(shape(F.col("token")).alias("shape")).agg(F.sum("n").alias("sn"))))
    known = counts.join(clean.select("token", F.col("n").alias("cn")), "token", "left").join(shapes, shape(F.col("token")) == F.col("shape"), "left")
    known = known.select("token", "n", F.log(F.coalesce("cn", F.lit(0)) + SHAPE_WEIGHT * F.coalesce("sn", F.lit(0)) + F.lit(1e-3)).alias("own"))
    whole = options.where(~F.col("word").contains(LOST))
    by_word = whole.join(clean.select(F.col("token").alias("bare"), F.col("n").alias("wn")), "bare", "left").join(shapes.withColumnRenamed("sn", "wsn"), shape(F.col("bare")) == F.col("shape"), "left").drop("shape")
    by_word = by_word.fillna(0, ["wn", "wsn"])
    ascii_left = ~F.col("bare").rlike(r"[^\x00-\x7F]")
    # UTF-8 sequences must give something that the corpus knows, and a remapped letter a word that it knows
    letters = F.regexp_replace("word", r"[\x00-\x7F]", "").rlike(r"\p{L}")
    script = F.col("bare").rlike(r"^[\x{0400}-\x{04FF}]{3,}$|^[\x{0370}-\x{03FF}]{3,}$")  # three sequences by chance are not of one script
    drawn = F.col("word").rlike(r"[\x{0080}-\x{009F}\x{2500}-\x{259F}]")
    supported = F.when(is_utf8, (F.col("wn") + F.col("wsn") > 0) | ascii_left | script).otherwise((~letters & ~drawn) | (F.col("wn") > 0))
    scored = by_word.where(supported).withColumn("p", F.col("wn") + SHAPE_WEIGHT * F.col("wsn") + F.lit(1e-3)).select("token", "channel", "word", "p", "odd", "token_odd")
    # wildcards: the most frequent corpus word that is a path of the lattice
    kind = "key string, fill string, wn long"

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t, n) for t, n in zip(batch["token"], batch["n"]) for k in fill_keys(t, False)]
            yield pd.DataFrame(rows, columns=["key", "fill", "wn"])

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for row in batch.itertuples(index=False) for k in fill_keys(row.bare, True)]
            yield pd.DataFrame(rows, columns=["key", *batch.columns])

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[[fits(w, list(a), f) for w, a, f in zip(batch["bare"], batch["allowed"], batch["fill"])]]
            likely = [lost_there(c, w, f) for c, w, f in zip(own["channel"], own["bare"], own["fill"])]
            yield own[["token", "channel", "fill", "wn"]].assign(weight=own["wn"] * [LIKELY if x else 1 for x in likely])

    open_ = options.where(F.col("word").contains(LOST)).select("token", "channel", "bare", "allowed")
    asked = open_.mapInPandas(opened, "key string, token string, channel string, bare string, allowed array<string>")
    fillers = clean.select("token", "n").mapInPandas(keyed, kind).join(asked.select("key").distinct(), "key", "left_semi")
    filled = asked.join(fillers, "key").select("token", "channel", "bare", "allowed", "fill", "wn").mapInPandas(checked, "token string, channel string, fill string, wn long, weight long")
    filled = filled.groupBy("token", "channel").agg(F.max_by(F.struct("fill", "wn"), F.struct("weight", "fill")).alias("x")).select("token", "channel", "x.*")
    # a word that the corpus does not have: by the marks of its shape, where these are nearly always the same
    pattern = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", LOST)
    marked = shapes.groupBy(pattern(F.col("shape")).alias("pattern")).agg(F.max_by("shape", F.struct("sn", "shape")).alias("model"), F.max("sn").alias("most"), F.sum("sn").alias("all")).where((F.col("most") >= 0.8 * F.col("all")) & ~F.col("model").rlike(r"\p{L}.*[^\x00-\x7F].*\p{L}"))
    lost = options.where(F.col("word").contains(LOST)).join(filled, ["token", "channel"], "left").join(marked, pattern(shape(F.col("bare"))) == F.col("pattern"), "left")
    word = F.coalesce("fill", F.when(F.col("channel") == "lost bytes", _transplanted("word", "model")), "word")
    rest = lost.select("token", "channel", word.alias("word"), (F.coalesce("wn", F.lit(0)) + F.lit(1e-3)).alias("p"), F.lit(0).alias("odd"), F.lit(0).alias("token_odd"))
    everything = scored.union(rest)
    # a sign that could be another sign says less than a word does
    plain = ~F.regexp_replace(F.concat("token", "word"), r"[\x00-\x7F]", "").rlike(r"\p{L}")
    bonus = F.when(is_utf8 | (F.col("channel") == "lost bytes"), VALID_UTF8).otherwise(ODD * (F.col("token_odd") - F.col("odd")) + F.when(plain, REMAPPED).otherwise(0.0))
    rated = everything.withColumn("score", F.log("p") + bonus).join(known.select("token", "own"), "token")
    # an option somewhat less likely than the word itself can still follow from the words beside it
    rated = rated.where((F.col("score") > F.col("own") + 2 * SWITCH) | F.col("token").contains(LOST))
    # at most one option a channel, of a fixed list of channels
    return rated.groupBy("token").agg(F.first("own").alias("own"), F.collect_list(F.struct("channel", "word", "score")).alias("options"))


_PATH = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("word", T.StringType()), T.StructField("channel", T.StringType())]))


def best_path(words: list[tuple[int, str, float, list[tuple[str, str, float]]]]) -> list[tuple[int, str, str, str]]:
    """The repaired words (pos, token, word, channel) of the best channel sequence of a row."""
    scores: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
    for pos, token, own, options in words:
        emitted: dict[str, tuple[float, str]] = {"": (own - (20.0 if LOST in token else 0.0), token)}
        for channel, word, score in options:
            emitted[channel] = (score, word)
        step: dict[str, tuple[float, tuple]] = {}
        top = max(scores.items(), key=lambda x: x[1][0])
        for channel, (score, word) in emitted.items():
            change = SWITCH + (0.0 if not channel or channel.startswith(("utf-8", "lost")) else REMAPPED)
            before = max((s + (0.0 if c == channel else change), c) for c, (s, _) in ((channel, scores.get(channel, (-math.inf, ()))), (top[0], top[1])))
            path = scores[before[1]][1]
            step[channel] = (before[0] + score, (path, (pos, token, word, channel)) if channel else path)
        scores = step
    path, out = max(scores.values(), key=lambda x: x[0])[1], []
    while path:
        path, last = path[0], path[1]
        out.append(last)
    return out[::-1]


@F.pandas_udf(_PATH)
def _decoded(rows: pd.Series) -> pd.Series:
    out = []
    for words in rows:
        ordered = sorted(((int(w["pos"]), w["token"], float(w["own"]), [(o["channel"], o["word"], float(o["score"])) for o in w["options"]]) for w in words), key=lambda w: w[0])
        out.append([{"pos": p, "token": t, "word": w, "channel": c} for p, t, w, c in best_path(ordered)])
    return pd.Series(out)


def find_garbled(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, version and repairs (pos, token, word, channel) of the rows whose text holds a garbled word.

    ``pos`` numbers the words with characters beyond ASCII in the text, ``version`` is a hash of the
    text, so that a key delivered with several texts keeps them apart; repeated rows count once. Lost
    bytes that nothing fits leave the word as it is, with its wildcards. Null, empty and ASCII texts
    are never garbled; rows with a null key are skipped; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = df.select(*keys, F.xxhash64(text).alias("version"), F.col(text).alias("text")).dropna(subset=keys)
    tokens = _tokens(rows)
    repairs = cut_lineage(token_repairs(tokens.select("token")))
    joined = tokens.join(broadcast_checked(repairs), "token")
    per_row = joined.groupBy(*keys, "version").agg(F.collect_set(F.struct("pos", "token", "own", "options")).alias("words"))
    return per_row.select(*keys, "version", _decoded("words").alias("repairs")).where(F.size("repairs") > 0)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_table(spark, sf_dir, "elements").select(F.lit("elements").alias("src"), F.col("element_id").alias("row_key"), "text")
    normalized = read_table(spark, sf_dir, "normalized_documents").select(F.lit("normalized_documents").alias("src"), F.col("doc_id").alias("row_key"), "text")
    return elements.unionByName(normalized)


_PY_TOKEN = re.compile(TOKEN)


def put_in_place(text: str, repairs: dict[int, str]) -> str:
    """``text`` with the words at the given numbers replaced; the punctuation around them stays."""
    number = -1

    def put(m: re.Match[str]) -> str:
        nonlocal number
        number += 1
        if number not in repairs:
            return m.group()
        left = m.group()[: len(m.group()) - len(m.group().lstrip(_ASCII_MARKS))]
        right = m.group()[len(m.group().rstrip(_ASCII_MARKS)) :]
        return left + repairs[number] + right

    return _PY_TOKEN.sub(put, text)


@F.pandas_udf(T.StringType())
def _replaced(text: pd.Series, repairs: pd.Series) -> pd.Series:
    return pd.Series([put_in_place(t, {int(f["pos"]): f["word"] for f in fixes}) for t, fixes in zip(text, repairs)], dtype=object)


def restored_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and restored, one row a garbled key: its garbled text (of several, that of the smallest hash) with every repaired word in its place."""
    found = find_garbled(df, keys, text)
    chosen = found.groupBy(*keys).agg(F.min_by(F.struct("version", "repairs"), "version").alias("x")).select(*keys, "x.*")
    texts = df.select(*keys, F.xxhash64(text).alias("version"), F.col(text).alias("__text"))
    joined = chosen.join(texts, [*keys, "version"]).groupBy(*keys).agg(F.first("__text").alias("__text"), F.first("repairs").alias("repairs"))
    return joined.select(*keys, _replaced("__text", "repairs").alias("restored"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_key, restored) of the garbled rows, with every repaired word in place."""
    return restored_texts(_texts(spark, sf_dir), ["src", "row_key"], "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_key) of the rows whose text holds a garbled sequence."""
    return find_garbled(_texts(spark, sf_dir), ["src", "row_key"], "text").select("src", "row_key").distinct()
