"""Problem 6: text that looks the same brought to one form.

Compatibility normalisation and deletion of ignorable characters come first. Each token that may
hold look-alike letters then spans a lattice of its characters and their look-alikes in the other
scripts; Viterbi search picks the path of the best character bigram score, where a change of script
inside a token, a change of a character, and a script other than the text's own cost extra.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import read_table

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аесіјѕорухһԁԛԝӏАВЕЅІЈКМНОРСТУХ", "aecijsopyxhdqwlABESIJKMHOPCTYX"))
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"))
TO_LATIN = CYRILLIC | GREEK

# The character classes of the problem statement, as regular-expression ranges.
FULL_WIDTH = "\uFF01-\uFF5E\uFFE0-\uFFE6"
LIGATURES = "\uFB00-\uFB06"
SPACES = "\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
ZERO_WIDTH = "\u180E\u200B-\u200F\u2060-\u2064\uFEFF"
LATIN = "A-Za-z\u00AA\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u1E00-\u1EFF\uFF21-\uFF3A\uFF41-\uFF5A\uFB00-\uFB06"
OTHER = "\u0370-\u0373\u0376-\u037D\u037F\u0386\u0388-\u03FF\u0400-\u0481\u048A-\u052F\u1F00-\u1FFF"
LOOKS_LATIN = "".join(TO_LATIN)

#: Java pattern of the texts that can hold any of it; all others keep their form.
SUSPECT = (
    f"[{FULL_WIDTH}{LIGATURES}{SPACES}{ZERO_WIDTH}]|\\p{{L}}\\p{{M}}"
    f"|[{LATIN}][\\p{{L}}\\p{{N}}]*[{OTHER}]|[{OTHER}][\\p{{L}}\\p{{N}}]*[{LATIN}]"
    f"|(?<![\\p{{L}}\\p{{N}}])\\p{{N}}*[{LOOKS_LATIN}][{LOOKS_LATIN}\\p{{N}}]*(?![\\p{{L}}\\p{{N}}])"
)

_WORD = re.compile(r"[^\W_]+")
_LATIN, _OTHER = re.compile(f"[{LATIN}]"), re.compile(f"[{OTHER}]")
_WIDE, _SPACE, _ZERO = re.compile(f"[{FULL_WIDTH}{LIGATURES}]"), re.compile(f"[{SPACES}]"), re.compile(f"[{ZERO_WIDTH}]")
_LOOKS = frozenset(LOOKS_LATIN)

#: Letters of the bigram model: Latin up to U+024F, then Greek and Cyrillic.
_BASE, _SIZE = 0x250, 0x250 + 0x1C0

#: Log scores: of a script change inside a token, a changed letter, a letter outside the text's main script, the first such letter.
SWITCH, CHANGE, FOREIGN, ENTER = -8.0, -1.0, -1.5, -4.0

_ALSO: dict[str, tuple[str, ...]] = {}
for _table in (CYRILLIC, GREEK):
    for _c, _l in _table.items():
        _ALSO[_c] = (*_ALSO.get(_c, ()), _l)
        _ALSO[_l] = (*_ALSO.get(_l, ()), _c)
for _c, _l in [*CYRILLIC.items(), *GREEK.items()]:
    _ALSO[_c] = tuple(dict.fromkeys((*_ALSO[_c], *(x for x in _ALSO[_l] if x != _c))))


def _codes(text: str) -> np.ndarray:
    """Model index of each character of lower-cased text; 0 for what is no letter of the model."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    wide = np.where((c >= 0x370) & (c < 0x530), c - 0x370 + _BASE, 0)
    low = np.where((c < _BASE) & ((c >= 0xC0) | ((c >= 0x61) & (c <= 0x7A))), c, 0)
    return low + wide


def _index(c: str) -> int:
    c = c.lower()
    return int(_codes(c)[0]) if len(c) == 1 else 0


def bigram_model(texts: DataFrame, text: str) -> np.ndarray:
    """Log probabilities of letter bigrams (index 0: a token's edge) over every row of ``texts``.

    Counted per Arrow batch and summed; the result has at most as many rows as the fixed alphabet
    of Latin, Greek and Cyrillic letters has pairs (about a million), whatever the data's size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SIZE * _SIZE, dtype=np.int64)
        for batch in batches:
            c = _codes("\n".join(["", *batch["t"], ""]))
            pairs = c[:-1] * _SIZE + c[1:]
            total += np.bincount(pairs[pairs > 0], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"pair": at, "n": total[at]})

    counted = texts.where(F.length(text) > 0).select(F.col(text).alias("t")).mapInPandas(count, "pair long, n long")
    rows = counted.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(_SIZE * _SIZE, 0.05)
    table[rows["pair"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
    table = table.reshape(_SIZE, _SIZE)
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _script(c: str) -> str:
    return "L" if _LATIN.match(c) else ("C" if "Ѐ" <= c <= "ԯ" else "G") if _OTHER.match(c) else ""


def restore(token: str, main: str, model: np.ndarray) -> str:
    """The best path through the token's look-alike lattice; ``main`` is the script of the text."""
    layers = [(c, *_ALSO.get(c, ())) for c in token]
    paths: list[tuple[float, str, str, int]] = [(0.0, "", "", 0)]  # score, text, script, last index
    for own, layer in zip(token, layers):
        fresh: dict[str, tuple[float, str, str, int]] = {}
        for c in layer:
            script, at = _script(c), _index(c)
            foreign = script not in ("", main)
            emit = CHANGE * (c != own) + FOREIGN * foreign
            best = max(
                ((score + emit + float(model[last, at]) + (0.0 if script in ("", before) else SWITCH if before else ENTER * foreign), text + c, script or before, at) for score, text, before, last in paths),
                key=lambda p: p[0],
            )
            if c not in fresh or fresh[c][0] < best[0]:
                fresh[c] = best
        paths = list(fresh.values())
    return max(paths, key=lambda p: p[0] + float(model[p[3], 0]))[1]


def one_form(text: str, model: np.ndarray) -> tuple[str, list[str]]:
    """(form, kinds): the consistent form of ``text`` and what it held; of words, what the search over their lattices made of them."""
    kinds = []
    if _WIDE.search(text):
        kinds.append("full_width")
    if _SPACE.search(text):
        kinds.append("space")
    if _ZERO.search(text):
        kinds.append("zero_width")
    if any(unicodedata.category(b)[0] == "M" and unicodedata.category(a)[0] == "L" for a, b in zip(text, text[1:]) if b > "\u02FF"):
        kinds.append("combining")
    form = unicodedata.normalize("NFKC", _ZERO.sub("", text).replace("\u00AD", ""))
    if not _OTHER.search(form):
        return form, kinds
    latin, other = len(_LATIN.findall(text)), len(_OTHER.findall(text))
    main = "L" if latin > other else ("C" if len(re.findall("[Ѐ-ԯ]", text)) * 2 >= other else "G")
    # a word that can hold look-alikes is inconsistent if the lattice has a better path than the word, or none within one script
    paths: dict[str, str] = {}

    def fix(m: re.Match[str]) -> str:
        word = m.group()
        if word not in paths:
            mixed = _OTHER.search(word) and _LATIN.search(word)
            alike = main == "L" and _OTHER.search(word) and all(c in _LOOKS for c in word if c.isalpha())
            paths[word] = restore(word, main, model) if mixed or alike else word
        return paths[word]

    # as they stand, before anything was joined or composed
    for word in set(_WORD.findall(text)):
        path = fix(_WORD.fullmatch(word))
        if path != word or (_OTHER.search(path) and _LATIN.search(path)):
            kinds.append("mixed" if _LATIN.search(word) else "look_alike")
    return _WORD.sub(fix, form), sorted(set(kinds))


def unify(df: DataFrame, keys: list[str], text: str, model: np.ndarray, only: Column | None = None) -> DataFrame:
    """``keys``, form and kinds of each row whose text is not plain ASCII (and meets ``only``).

    Plain ASCII is its own form. Null texts give no row, repeated rows repeat, an empty table gives
    an empty result, and other columns are ignored. No shuffle; the model goes out as one broadcast
    of fixed size.
    """
    chosen = df.where(F.col(text).rlike(r"[^\x00-\x7F]"))
    chosen = (chosen if only is None else chosen.where(only)).select(*keys, F.col(text).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text"), "form string", "kinds array<string>"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one_form(t, shared.value) for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(form=[f for f, _ in done], kinds=[k for _, k in done])

    return chosen.mapInPandas(work, schema)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_table(spark, sf_dir, "elements").select(F.lit("elements").alias("src"), F.col("element_id").alias("row_key"), "text")
    evidence = read_table(spark, sf_dir, "evidence").select(F.lit("evidence").alias("src"), F.col("evidence_id").cast("string").alias("row_key"), F.col("quote").alias("text"))
    return elements.unionByName(evidence)


def changed_forms(texts: DataFrame, keys: list[str], model: np.ndarray) -> DataFrame:
    """``keys`` and form of each row whose text differs from its consistent form, whatever it held."""
    return unify(texts, [*keys, "text"], "text", model).where("form <> text").select(*keys, "form")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_key, form) of every text that is not in the consistent form."""
    texts = _texts(spark, sf_dir)
    return changed_forms(texts, ["src", "row_key"], bigram_model(texts, "text")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_key) of the rows that hold look-alikes of any kind, by what the consistent form did to them."""
    texts = _texts(spark, sf_dir)
    found = unify(texts, ["src", "row_key"], "text", bigram_model(texts, "text"), only=F.col("text").rlike(SUSPECT))
    return found.where(F.size("kinds") > 0).select("src", "row_key").distinct()


def _p6_sql() -> str:
    hit = (
        f"regexp_matches(t, '[{FULL_WIDTH}{LIGATURES}{SPACES}{ZERO_WIDTH}]|\\p{{L}}\\p{{M}}|[{LATIN}][\\p{{L}}\\p{{N}}]*[{OTHER}]|[{OTHER}][\\p{{L}}\\p{{N}}]*[{LATIN}]')"
        f" OR (length(regexp_replace(t, '[^{LATIN}]', '', 'g')) > length(regexp_replace(t, '[^{OTHER}]', '', 'g'))"
        f" AND regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])\\p{{N}}*[{LOOKS_LATIN}][{LOOKS_LATIN}\\p{{N}}]*($|[^\\p{{L}}\\p{{N}}])'))"
    )
    return f"""
WITH x AS (SELECT 'elements' AS src, element_id AS row_key, text AS t FROM elements UNION ALL SELECT 'evidence', CAST(evidence_id AS VARCHAR), quote FROM evidence)
SELECT DISTINCT src, row_key FROM x WHERE {hit}
"""


P6_FOUND_SQL = _p6_sql()
