"""Problem 1: noise in text from scanned pages.

Running headers and footers are lines at page edges that repeat, fuzzily, the title, an earlier
heading or other edge lines of the upload; page numbers are the page's own or of a sequence of the
upload. Both are also looked for on lines inside elements, since a page end may lie there. Divided
words are told from hyphenated ones by the corpus vocabulary, and misread words are rare words that
one recognition error separates from a far more frequent, or far more word-like, one.

In all of these, elements without an id or a page number and null, empty or blank texts have no noise;
a repeated element counts once; an empty table gives an empty result; columns other than doc_id,
element_id, element_type, text, ord and page_number are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import broadcast_checked, cut_lineage, fits_broadcast, read_table

# What was printed and what recognition makes of it.
CONFUSIONS = {
    "e": "c", "t": "f", "o": "0", "n": "ri", "i": "l", "l": "1", "s": "5", "u": "ii", "d": "cl", "h": "b", "g": "9", "m": "rn", "w": "vv",
    "li": "h", "q": "g", "a": "o", "B": "8", "b": "8", "O": "0", "I": "l", "S": "5", "E": "F", "M": "N", "G": "6", "Z": "2", "c": "e", "f": "t", "rn": "m", "r": "n", "U": "V", "D": "O", "C": "G", "T": "I", "H": "N", "R": "P", "L": "I",
}
# Marks that divide a word at a line end; the second kind never belongs to a word.
HYPHENS, SOFT = "-\u2010\u2011\u00AC\u00AD", "\u00AC\u00AD"
# Words printed before a page number.
PAGE_WORDS = r"(?:page|seite|pagina|página|pág|strona|str|стр|страница|стр|p|s|с|pg|bl|blatt|feuille|hoja)"
#: A page number (group 1) in arabic or roman digits that may be misread, with what may stand around it.
_AROUND = r"[\s\-\x{2013}\x{2014}\[\](){}|.~*·•]*"
_NUMBER = rf"{_AROUND}(?:(?:{PAGE_WORDS}|[spc5]\p{{L}}{{2,5}})\b\.?\s*)?[\-\x{{2013}}\x{{2014}}\[( ]*([0-9lIOoSBZgGiIvVxX|]{{1,6}})(?: ?(?:/|of|von|de|sur|z|из) ?[0-9lIOoSBZgivxIVX|]{{1,5}})?{_AROUND}"
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(rf"\S+[{HYPHENS}][^\S\n]*\n\s*\S+|\S+[{HYPHENS}]\s*$")
_BREAKS = re.compile(rf"[{HYPHENS}][^\S\n]*(?:\n|$)")
_DIVIDED = re.compile(rf"[^{HYPHENS}\s]*[{HYPHENS}](?:[^\S\n]*\n\s*\S+|\s*$)")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_ZERO = re.compile("[\u200B-\u200D\u2060\uFEFF]")


def ocr_key(column: Column) -> Column:
    """A line without case, digits, blanks and marks, with letters that are mistaken for each other made one."""
    out = F.translate(F.lower(column), "01l5896qefah", "oiisbgggctob")
    for a, b in (("rn", "m"), ("ri", "n"), ("ci", "d"), ("vv", "w"), ("ii", "u")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\p{L}]", "")


def _number_of(raw: Column) -> tuple[Column, Column]:
    """(arabic, roman) value of a page number that may be misread; null where it is none."""
    digits = F.translate(raw, "lI|OoSBZgG", "1110058296")
    arabic = F.when(raw.rlike("[0-9]|^[lIOo]{1,3}$") & digits.rlike(r"^\d{1,4}$"), digits.cast("int"))
    roman_text = F.translate(F.lower(raw), "l1|", "iii")
    fixed = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]
    roman = F.array_position(F.array(*map(F.lit, fixed)), roman_text)
    return arabic, F.when(roman > 0, roman.cast("int"))


def _lines(text: Column) -> Column:
    """The lines of a text without the blanks around them; blank lines are none."""
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\n\x0b\f\r"))), lambda line: line != "")


def _split(text: str) -> list[str]:
    """The same lines as :func:`_lines` in Python."""
    return [line for part in text.split("\n") if (line := part.strip(" \t\n\x0b\f\r"))]


def _filled(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("element_id").isNotNull() & F.col("page_number").isNotNull() & (F.length(F.trim("text", F.lit(" \t\n\x0b\f\r"))) > 0))


def page_edges(elements: DataFrame) -> DataFrame:
    """The first line of each page's first element and the last line of its last: doc_id, page, edge, ord, element_id, element_type, line, lines, at, beside.

    By partial aggregation over (upload, page), so a large upload is no hot group. ``at`` is the place
    of the line in its element, from 0; ``beside`` is the line above a last one.
    """
    rows = _filled(elements).withColumn("ls", _lines(F.col("text")))
    end = lambda line, at, by: F.struct("ord", "element_id", "element_type", line.alias("line"), F.size("ls").alias("lines"), at.alias("at"), by.alias("beside"))
    pages = rows.groupBy("doc_id", F.col("page_number").alias("page")).agg(F.min_by(end(F.get("ls", F.lit(0)), F.lit(0), F.lit(None).cast("string")), "ord").alias("top"), F.max_by(end(F.try_element_at("ls", F.lit(-1)), F.size("ls") - 1, F.get("ls", F.size("ls") - 2)), "ord").alias("bottom"))
    return pages.select("doc_id", "page", F.inline(F.array(F.struct(F.lit("top").alias("edge"), F.col("top").alias("x")), F.struct(F.lit("bottom").alias("edge"), F.col("bottom").alias("x"))))).select("doc_id", "page", "edge", "x.*")


def inner_lines(elements: DataFrame, chosen: Callable[[Column], Column], least: int = 1) -> DataFrame:
    """The chosen lines of the running text of paged elements, in the columns of :func:`page_edges` with the edge 'inside'.

    A page end may lie inside an element. Lines that end a sentence are no furniture there. Lines are
    chosen inside the row, so only those become rows; ``least`` is the number of lines an element has.
    """
    rows = _filled(elements).where(F.col("element_type").isin("text", "paragraph")).where(F.lit(least < 2) | F.contains("text", F.lit("\n"))).withColumn("ls", _lines(F.col("text")))
    placed = F.filter(F.transform("ls", lambda line, at: F.struct(at.alias("at"), line.alias("line"))), lambda x: (F.length(x.line) <= 90) & ~x.line.rlike(r"[.!?:]$") & chosen(x.line))
    lines = rows.select("doc_id", "page_number", "ord", "element_id", "element_type", F.size("ls").alias("lines"), F.explode(placed).alias("x")).where(F.col("lines") >= least)
    return lines.select("doc_id", F.col("page_number").alias("page"), F.lit("inside").alias("edge"), "ord", "element_id", "element_type", "x.line", "lines", "x.at")


def _halves(key: str) -> Column:
    """Two keys, of which one survives any damage to the other half of a line."""
    half = F.greatest(F.lit(1), F.floor(F.length(key) / 2).cast("int"))
    return F.array(F.concat(F.lit("a"), F.substring(F.col(key), F.lit(1), half)), F.concat(F.lit("z"), F.substring(F.col(key), F.length(key) - half + 1, half)))


def find_furniture(elements: DataFrame) -> DataFrame:
    """(element_id, edge, at): lines that are a running header, footer or page number, by their place in the element.

    ``edge`` is top or bottom of a page, or inside for lines that stand alone elsewhere. Those are
    held against the sequence of page numbers and the running lines of the upload's page edges.
    """
    edges = page_edges(elements)
    # a page number may stand beside the running text, several blanks apart
    beside = rf"(?i)^{_NUMBER}\s{{3,}}(?=\S)|(?<=\S)\s{{3,}}{_NUMBER}$"
    split = edges.withColumn("body", F.trim(F.regexp_replace("line", beside, "")))
    aside = F.trim(F.when(F.col("body") == F.trim("line"), F.col("line")).otherwise(F.replace("line", "body", F.lit(""))))
    split = split.withColumn("aside", aside).withColumn("raw", F.regexp_extract("aside", f"(?i)^{_NUMBER}$", 1))
    arabic, roman = _number_of(F.col("raw"))
    split = cut_lineage(split.withColumn("arabic", arabic).withColumn("roman", roman).withColumn("apart", (F.col("lines") == 1) | F.coalesce(F.col("beside").rlike(r"[.!?:]$"), F.lit(False))).withColumn("key", ocr_key(F.col("body"))))
    # page numbers: at the page's own number, or in a sequence that other pages of the upload carry on
    numbered = split.where(F.col("raw") != "")
    offsets = numbered.where(F.col("arabic").isNotNull()).groupBy("doc_id", (F.col("page") - F.col("arabic")).alias("shift")).agg(F.countDistinct("page").alias("support"))
    front = numbered.where(F.col("roman") == F.col("page")).select("doc_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("after_front")).distinct()
    # one pattern over the whole text leaves few elements whose lines are looked at
    some = elements.where(F.col("text").rlike(rf"(?imd)^[ \t\x0B\f\r]*{_NUMBER}[ \t\x0B\f\r]*$"))
    alone = inner_lines(some, lambda line: line.rlike(f"(?i)^{_NUMBER}$")).withColumn("raw", F.regexp_extract("line", f"(?i)^{_NUMBER}$", 1)).withColumn("aside", F.col("line"))
    arabic, roman = _number_of(F.col("raw"))
    alone = alone.withColumn("arabic", arabic).withColumn("roman", roman).withColumn("apart", F.lit(False))
    columns = ["doc_id", "page", "element_id", "edge", "at", "raw", "aside", "arabic", "roman", "apart"]
    both = numbered.select(*columns).union(alone.select(*columns)).withColumn("shift", F.col("page") - F.col("arabic"))
    known = both.join(offsets, ["doc_id", "shift"], "left").join(front, ["doc_id", "page"], "left")
    # a bare number needs a second page of its sequence, the end of roman front matter before it, or a place of its own where no sentence goes on
    early = F.col("shift").between(1, 12) & ((F.col("support") >= 2) | (F.col("aside") != F.col("raw")) | (F.col("after_front") & (F.col("arabic") == 1)) | F.col("apart"))
    fits = (F.col("roman") == F.col("page")) | (F.col("arabic") > 0) & ((F.col("shift") == 0) | early | (F.col("support") >= 3))
    numbers = known.where(fits).select("element_id", "edge", "at")
    # running lines: the title, or a heading that stood before, or a line that tops other pages too
    lines = split.where(F.col("element_type").isin("text", "paragraph", "heading") & (F.length("key") >= 4) & ~F.col("line").rlike(r":\s*$") & (F.length("body") <= 90))
    heads = elements.where((F.col("element_type") == "heading") & F.col("page_number").isNotNull() & ~F.col("text").contains("\n")).select("doc_id", "ord", F.trim(F.col("text")).alias("t")).withColumn("head", ocr_key(F.col("t")))
    heads = heads.where(F.length("head") >= 4).groupBy("doc_id", "head").agg(F.min("ord").alias("first"), F.length(F.min("t")).alias("head_chars"))
    near = lambda a, b: F.levenshtein(F.col(a), F.col(b)) <= F.greatest(F.lit(1), F.floor(F.length(b) / 8))
    # of "office — title", the part after a dash repeats the title
    tail = F.when(F.col("body").rlike(r"\s[\x{2014}\x{2013}]\s"), ocr_key(F.regexp_replace("body", r"^.*\s[\x{2014}\x{2013}]\s", "")))
    whole = F.when((F.col("page") > 1) | (F.col("edge") == "bottom"), F.col("key"))
    left = lines.select("doc_id", "element_id", "edge", "at", "ord", F.explode(F.array_compact(F.array(whole, tail))).alias("probe")).select("*", F.explode(_halves("probe")).alias("half"))
    right = heads.select("doc_id", "head", "first", F.explode(_halves("head")).alias("half"))
    repeats = left.join(right, ["doc_id", "half"]).where((F.col("first") < F.col("ord")) & near("probe", "head")).select("element_id", "edge", "at")
    # lines that repeat among themselves, misread or not, on three pages or more in the same place; each reading counts its pages first, so many pages are no hot group
    plain = lines.where(F.col("element_type").isin("text", "paragraph") & (F.col("page") > 1) & (F.length("key") >= 6) & ~F.col("line").rlike(r"[.!?]\s*$"))
    readings = plain.groupBy("doc_id", "edge", "key").agg(F.countDistinct("page").alias("pages"))
    halved = readings.select("doc_id", "edge", "key", "pages", F.explode(_halves("key")).alias("half"))
    like = halved.alias("a").join(halved.select("doc_id", "edge", "half", F.col("key").alias("other"), F.col("pages").alias("more")).alias("b"), ["doc_id", "edge", "half"]).where((F.col("key") != F.col("other")) & near("key", "other"))
    like = like.select("doc_id", "edge", "key", "other", "more").distinct().groupBy("doc_id", "edge", "key").agg(F.sum("more").alias("more"))
    again = readings.join(like, ["doc_id", "edge", "key"], "left").where(F.col("pages") + F.coalesce("more", F.lit(0)) >= 3)
    running = plain.join(again, ["doc_id", "edge", "key"], "left_semi").select("element_id", "edge", "at")
    out = cut_lineage(numbers.union(repeats).union(running).distinct())
    # inside elements: lines that repeat a running line of the upload
    runs = split.where("length(key) >= 6").join(out.where("edge <> 'inside'"), ["element_id", "edge", "at"], "left_semi").groupBy("doc_id", F.col("key").alias("run")).agg(F.countDistinct("page").alias("pages")).where("pages >= 2")
    runs = cut_lineage(runs.select("doc_id", "run"))
    small = broadcast_checked(runs)
    inner = inner_lines(elements.join(small, "doc_id", "left_semi"), lambda line: F.length(line) >= 6, least=2).withColumn("run", ocr_key(F.col("line")))
    again = inner.join(small, ["doc_id", "run"], "left_semi")
    return out.union(again.select("element_id", "edge", "at")).distinct()


def word_counts(elements: DataFrame) -> DataFrame:
    """(word, paged, other): how often each word, and each hyphenated compound inside a line, stands in elements with and without a page number.

    Counted in every Arrow batch first, so about one row a distinct word and task is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paged: Counter[str] = Counter()
        other: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            every = list({*paged, *other})
            return pd.DataFrame({"word": pd.Series(every, dtype=object), "paged": [paged[w] for w in every], "other": [other[w] for w in every]})

        for batch in batches:
            for text, page in zip(batch["text"], batch["page"]):
                clean = _ZERO.sub("", text)
                if _BREAKS.search(clean):
                    clean = _BREAK.sub(" ", clean)
                own = paged if page else other
                own.update(_WORD.findall(clean))
                if "-" in clean:
                    own.update(_COMPOUND.findall(clean))
            if len(paged) + len(other) > 400_000:
                yield out()
                paged.clear()
                other.clear()
        yield out()

    rows = elements.where(F.length("text") > 0).select("text", F.col("page_number").isNotNull().alias("page"))
    return rows.mapInPandas(count, "word string, paged long, other long").groupBy("word").agg(F.sum("paged").alias("paged"), F.sum("other").alias("other"))


_REVERSE: dict[str, list[str]] = {}
for _true, _seen in CONFUSIONS.items():
    _REVERSE.setdefault(_seen, []).append(_true)


def corrections(word: str) -> list[str]:
    """Words that one recognition error turns into ``word``; of digits inside letters, all are undone together."""
    out = set()
    for seen, trues in _REVERSE.items():
        at = word.find(seen)
        while at >= 0:
            for true in trues:
                out.add(word[:at] + true + word[at + len(seen) :])
            at = word.find(seen, at + 1)
    if any(c.isdigit() for c in word):
        table = {"0": "oO", "1": "li", "5": "sS", "9": "g", "8": "bB", "6": "G", "2": "Z"}
        upper = sum(c.isupper() for c in word) > sum(c.islower() for c in word)
        out.add("".join((table.get(c, c)[-1 if upper else 0]) for c in word))
    out.discard(word)
    capitals = sum(c.isupper() for c in word) > 1
    return [w for w in out if w.isalpha() and (capitals or not any(c.isupper() for c in w[1:]))]


def _trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("^^"), F.lower(word), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))


def letter_model(counts: DataFrame) -> dict[str, float]:
    """Log probability of each letter given the two before it, over the words seen without page numbers.

    Words count as often as they stand there. The table is bounded by the trigrams of the fixed Latin
    alphabet.
    """
    words = counts.where((F.col("other") > 0) & F.col("word").rlike(r"^[A-Za-z\x{00C0}-\x{017F}]{3,}$"))
    tri = words.select(F.explode(_trigrams(F.col("word"))).alias("t"), F.col("other").alias("w")).groupBy("t").agg(F.sum("w").alias("n")).toPandas()
    total: Counter[str] = Counter()
    for t, n in zip(tri["t"], tri["n"]):
        total[t[:2]] += n
    out = {t: float(np.log((n + 0.02) / (total[t[:2]] + 1.0))) for t, n in zip(tri["t"], tri["n"])}
    out[""] = float(np.log(0.02 / 50.0))
    return out


def _log_likelihood(word: str, model: dict[str, float]) -> float:
    padded = f"^^{word.lower()}$"
    low = model[""]
    return sum(model.get(padded[i : i + 3], low) for i in range(len(padded) - 2))


_CODE = re.compile(r"\d+|[A-Z]{1,4}\d+|\d+[A-Z]|[A-Z]+")


#: Java pattern of words as printed or misread: at most the first letter, or all letters but an l, capital; strings of mixed case are data.
_SHAPE = r"^(?:[A-Z0-9\x{00C0}-\x{00DE}]?(?=[0-9]*\p{Ll})[a-z0-9\x{00DF}-\x{017F}]{2,}|[0-9][a-z]|[a-z][0-9]|[A-Z0-9\x{00C0}-\x{00DE}]+l?[A-Z0-9\x{00C0}-\x{00DE}]{3,})$"


def misread_words(counts: DataFrame, score: float = 3.0) -> DataFrame:
    """(word, correction): words of pages that a recognition error explains better than they do themselves.

    A misread word is hardly ever seen outside pages, and its correction is far more frequent or far
    more like the corpus's words: the gain in log count and in the letter model together must exceed
    ``score``. Codes and numbers cannot be judged; words of capitals only are judged by counts alone.
    """
    model = counts.sparkSession.sparkContext.broadcast(letter_model(counts))
    suspects = counts.where((F.col("paged") > 0) & (F.col("other") * 20 <= F.col("paged")) & F.col("word").rlike(_SHAPE))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, paged in zip(batch["word"], batch["paged"]):
                if _CODE.fullmatch(word) and not (word.isupper() and word.isalpha()):
                    continue
                own = _log_likelihood(word, model.value)
                for fixed in corrections(word):
                    rows.append((word, paged, fixed, fixed.lower(), _log_likelihood(fixed, model.value) - own))
            yield pd.DataFrame(rows, columns=["word", "paged", "fixed", "low", "gain"])

    options = suspects.select("word", "paged").mapInPandas(spread, "word string, paged long, fixed string, low string, gain double")
    folded = counts.groupBy(F.lower("word").alias("low")).agg(F.sum(F.col("paged") + F.col("other")).alias("n"), F.sum("other").alias("n_other"))
    joined = options.join(folded, "low", "left")
    own = folded.select(F.col("low").alias("own_low"), F.col("n").alias("own_n"))
    joined = joined.withColumn("own_low", F.lower("word")).join(own, "own_low", "left")
    more = F.log((F.coalesce("n", F.lit(0)) + 0.1) / (F.coalesce("own_n", "paged") + 0.1))
    seen = F.coalesce("n_other", F.lit(0)) > 0
    total = more + F.when(F.col("word").rlike("[a-z]"), 0.5 * F.col("gain")).otherwise(0.0) + F.when(seen, 0.0).otherwise(-2.0)
    rated = joined.withColumn("total", total).where(F.col("total") > score)
    return rated.groupBy("word").agg(F.max_by("fixed", "total").alias("correction"), F.max("total").alias("total"))


def _misread_hits(paged: DataFrame, wrong: DataFrame) -> DataFrame:
    """(element_id, at, word, correction): where misread words stand, by line.

    One function reads the words of every line. While the misread words fit into a broadcast of
    bounded size, it gives only those; else it gives the distinct words of each line that could be
    any, and a shuffle join finds the misread ones among them.
    """
    kind = paged.schema["element_id"].dataType.simpleString()
    shared = None
    if fits_broadcast(wrong):
        shared = paged.sparkSession.sparkContext.broadcast({r.word for r in wrong.select("word").toLocalIterator()})

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value if shared is not None else None
        for batch in batches:
            rows = []
            for element, text in zip(batch["element_id"], batch["text"]):
                clean = _ZERO.sub("", text)
                if known is not None and known.isdisjoint(_WORD.findall(clean)):
                    continue
                clean = "\n".join(_split(clean))
                if _BREAKS.search(clean):
                    clean = _DIVIDED.sub("\n", clean)
                for at, line in enumerate(clean.split("\n")):
                    own = set(_WORD.findall(line))
                    rows += [(element, at, w) for w in (own if known is None else own & known)]
            yield pd.DataFrame(rows, columns=["element_id", "at", "word"])

    hits = paged.select("element_id", "text").mapInPandas(match, f"element_id {kind}, at int, word string")
    return hits.join(wrong if shared is None else F.broadcast(wrong), "word").select("element_id", "at", "word", "correction")


def find_misread(elements: DataFrame, counts: DataFrame, furniture: DataFrame) -> DataFrame:
    """(element_id, word, correction): misread words outside running headers, footers and page numbers.

    Words divided at a line end are judged as such, and their halves are no words. Tables and code
    are no body text.
    """
    wrong = cut_lineage(misread_words(counts).select("word", "correction"))
    paged = elements.where(F.col("element_id").isNotNull() & F.col("page_number").isNotNull() & (F.length("text") > 0) & ~F.col("element_type").isin("table", "code_block"))
    hits = _misread_hits(paged, wrong)
    kept = hits.join(furniture.select("element_id", "at").distinct(), ["element_id", "at"], "left_anti")
    return kept.select("element_id", "word", "correction").distinct()


def find_divided(elements: DataFrame, counts: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """(element_id, left, mark, right): words divided at a line end or at the end of the element (right is empty).

    The corpus decides: the joined word against the hyphenated compound, each by its count inside
    lines; unknown ones are divided unless both parts are words of their own or the second is a
    number or capitalised. Lines of ``furniture`` are taken out first, as a word may be divided over them.
    """
    rows = elements.where(F.col("element_id").isNotNull() & F.col("page_number").isNotNull() & F.col("text").rlike(rf"\p{{L}}[{HYPHENS}][^\S\n]*(?:\n|$)"))
    if furniture is not None:
        gone = furniture.groupBy("element_id").agg(F.collect_set("at").alias("gone"))
        body = F.array_join(F.filter(_lines(F.col("text")), lambda line, at: ~F.array_contains("gone", at)), "\n")
        rows = rows.join(gone, "element_id", "left").withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(body))
    pattern = rf"(\p{{L}}+)([{HYPHENS}])[^\S\n]*(?:\n[^\p{{L}}\p{{N}}]*([\p{{L}}\p{{N}}]+)|\s*$)"
    group = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    pairs = rows.select("element_id", F.inline(F.arrays_zip(group(1).alias("left"), group(2).alias("mark"), group(3).alias("right")))).distinct()
    pairs = pairs.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat_ws("-", "left", "right")))
    pairs = pairs.withColumn("l", F.lower("left")).withColumn("r", F.lower("right"))
    folded = counts.groupBy(F.lower("word").alias("w")).agg(F.sum(F.col("paged") + F.col("other")).alias("n"))
    heads = folded.where(F.col("w").contains("-")).groupBy(F.substring_index("w", "-", 1).alias("l")).agg(F.sum("n").alias("n_head"))
    # look up only the keys that occur here, which are few beside the vocabulary
    keys = pairs.select(F.explode(F.array("joined", "compound", "l", "r")).alias("w")).distinct()
    known = folded.join(keys, "w")
    of = lambda key, name: known.select(F.col("w").alias(key), F.col("n").alias(name))
    out = pairs.join(of("joined", "n_joined"), "joined", "left").join(of("compound", "n_compound"), "compound", "left").join(of("l", "n_left"), "l", "left").join(of("r", "n_right"), "r", "left").join(heads, "l", "left")
    out = out.fillna(0, ["n_joined", "n_compound", "n_left", "n_right", "n_head"])
    open_end = F.col("right") == ""
    divided = (
        F.when(F.col("mark").isin(*SOFT), True)
        .when(open_end, F.col("n_head") <= F.col("n_left") * 0.02)
        .when(F.col("n_joined") != F.col("n_compound"), F.col("n_joined") > F.col("n_compound"))
        .when(F.col("right").rlike(r"^[\p{N}\p{Lu}]"), False)
        .otherwise((F.col("n_left") < 5) | (F.col("n_right") < 5))
    )
    return out.where(divided).select("element_id", "left", "mark", "right")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "elements").select("doc_id", "element_id", "element_type", "text", "ord", "page_number")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element_id, noise) of every kind of noise in an element of a paged upload."""
    elements = _elements(spark, sf_dir)
    counts = cut_lineage(word_counts(elements))
    furniture = cut_lineage(find_furniture(elements))
    kinds = (("furniture", furniture), ("hyphen", find_divided(elements, counts, furniture)), ("misread", find_misread(elements, counts, furniture)))
    out = None
    for noise, found in kinds:
        part = found.select("element_id", F.lit(noise).alias("noise")).distinct()
        out = part if out is None else out.union(part)
    return out


@F.pandas_udf(T.StringType())
def _clean(text: pd.Series, gone: pd.Series, fixes: pd.Series, divided: pd.Series) -> pd.Series:
    """Body text of an element: without furniture, misread words corrected, divided words and lines joined."""
    out = []
    for t, places, words, marks in zip(text, gone, fixes, divided):
        drop = set(places) if places is not None else ()
        body = "\n".join(line for at, line in enumerate(_split(t or "")) if at not in drop)
        for f in words if words is not None else ():
            body = re.sub(rf"(?<![^\W_]){re.escape(f['word'])}(?![^\W_])", f["correction"].replace("\\", ""), body)
        for d in marks if marks is not None else ():
            if d["right"]:
                body = re.sub(rf"{re.escape(d['left'] + d['mark'])}[^\S\n]*\n(\W*){re.escape(d['right'])}", lambda m, d=d: d["left"] + d["right"], body)
        body = re.sub(r"(?<=[^\W\d_]-)\n", "", body)
        out.append(re.sub(r"[^\S\n]*\n[^\S\n]*", " ", body).strip())
    return pd.Series(out, dtype=object)


def repair_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page, ord, element_id, element_type, text): the paged elements as continuous readable paragraphs.

    Furniture is gone, misread words are corrected, divided words and wrapped lines are joined, and
    a paragraph that runs over one page end or more is put together under its first part. Each page end
    is an equi-join of one page's last body element with the next page's first, and only the parts of
    one paragraph meet, so no upload is gathered in one task. Elements without a page number or
    without text have no row; repeated rows of an element count once.
    """
    elements = elements.where(F.col("element_id").isNotNull()).groupBy("element_id").agg(F.min_by(F.struct("doc_id", "element_type", "text", "ord", "page_number"), F.struct("ord", "text")).alias("e")).select("element_id", "e.*")
    counts = cut_lineage(word_counts(elements))
    furniture = cut_lineage(find_furniture(elements))
    fixes = find_misread(elements, counts, furniture).groupBy("element_id").agg(F.collect_set(F.struct("word", "correction")).alias("fixes"))
    marks = find_divided(elements, counts, furniture)
    parted = marks.groupBy("element_id").agg(F.collect_set(F.struct("left", "mark", "right")).alias("divided"), F.max(F.when(F.col("right") == "", F.concat("left", "mark"))).alias("open_mark"))
    edge = furniture.groupBy("element_id").agg(F.collect_set("at").alias("gone"))
    rows = elements.where(F.col("page_number").isNotNull()).join(edge, "element_id", "left").join(fixes, "element_id", "left").join(parted, "element_id", "left")
    body = rows.withColumn("body", _clean("text", "gone", "fixes", "divided")).where(F.length("body") > 0).select("doc_id", F.col("page_number").alias("page"), "ord", "element_id", "element_type", F.col("body").alias("text"), "open_mark")
    body = cut_lineage(body)
    last = body.groupBy("doc_id", "page").agg(F.max_by(F.struct("element_id", "element_type", "text", "open_mark"), "ord").alias("l"))
    first = body.groupBy("doc_id", "page").agg(F.min_by(F.struct("element_id", "element_type", "text"), "ord").alias("f"))
    runs_on = (F.col("l.element_type") == "paragraph") & (F.col("f.element_type") == "paragraph") & ~F.col("l.text").rlike(r"[.!?:][\"'\x{201D}\x{00BB})]*$") & F.col("f.text").rlike(r"^[\p{Ll}\p{N}]")
    links = last.join(first.select("doc_id", (F.col("page") - 1).alias("page"), "f"), ["doc_id", "page"]).where(runs_on & (F.col("l.element_id") != F.col("f.element_id")))
    links = cut_lineage(links.select(F.col("f.element_id").alias("element_id"), F.col("l.element_id").alias("head")))
    # a paragraph may run on over several pages: each link is followed to the paragraph's first part
    while True:
        further = links.join(links.select(F.col("element_id").alias("head"), F.col("head").alias("before")), "head", "left")
        jumped = cut_lineage(further.select("element_id", F.coalesce("before", "head").alias("head"), F.col("before").isNotNull().alias("moved")))
        links = jumped.select("element_id", "head")
        if not jumped.where("moved").limit(1).count():
            break
    rests = links.union(links.select("head", "head").distinct())
    # every part but the last without its dividing mark, and with a blank unless a word goes on
    divided = F.col("open_mark").isNotNull() & F.col("text").endswith(F.col("open_mark"))
    stem = F.when(divided, F.expr("substring(text, 1, length(text) - 1)")).when(F.col("text").rlike(r"\p{L}-$"), F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    parts = body.join(broadcast_checked(rests), "element_id").groupBy(F.col("head").alias("element_id")).agg(F.array_sort(F.collect_list(F.struct("page", "ord", "element_id", stem.alias("stem"), "text"))).alias("p"))
    whole = F.concat(F.array_join(F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: x.stem), ""), F.element_at("p", -1).text)
    # few paragraphs run over a page, so while their texts fit a broadcast the others are not shuffled again
    heads = cut_lineage(parts.select("element_id", whole.alias("whole")))
    joined = body.join(broadcast_checked(heads), "element_id", "left").join(broadcast_checked(links.select("element_id")), "element_id", "left_anti")
    return joined.select("doc_id", "page", "ord", "element_id", "element_type", F.coalesce("whole", "text").alias("text"))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired text of the paged uploads, an element a row, in (doc_id, ord) order."""
    return repair_pages(_elements(spark, sf_dir))
