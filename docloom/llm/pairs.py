"""Problem 4: defective prompt and response pairs, by labelling functions and a label model.

Every defect has several noisy labelling functions that vote yes, no, or abstain. Expectation
maximisation estimates each function's accuracy and the defect's rate from how the votes agree, and
a pair has the defect if its posterior exceeds a cutoff. Cutoffs are validated on all sound pairs,
into which defects are planted: each is the one of the best F1 there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import words
from docloom.llm.endings import ending_features, incomplete, line_statistics
from docloom.session import cut_lineage, read_table

#: In order of precedence where only one label is wanted.
DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and is to in that for be must with at it when which who what how why where and not are was by on its this from as an or if before after each between while",
    "de": "der die das und ist zu den dem nicht wird für mit von am wenn im nach bei ein eine einen wie warum wer welche auf zur zum über sich seit laut ohne darf gilt vor",
    "fr": "le la les des est dans une un pour du sur et que au aux qui de ce se par avec sans si près comment pourquoi quel quelle depuis selon en ne pas cette sous",
    "es": "el la los las de del que en y con una un para al por se según fue desde qué cómo quién cuál cuando sin más está tras su sus no entre hasta lo pero como me esto ha le",
    "it": "il lo gli della delle dei che per con una non sono come è nel alla perché quando",
    "pt": "o os das dos uma não com para que é são como quando pela pelo mais em",
    "nl": "het een van en niet voor met dat zijn wordt bij naar als wanneer hoe waarom",
    "pl": "się nie jest oraz dla jak który która przez przed po od do na w z że",
    "ru": "и в не на что для после перед по при как из от это если который",
}
# Letters that point to a language.
LETTERS = {"de": "äöüß", "fr": "èêçœàùûîëï", "es": "ñ¿¡óíú", "pl": "łąęśżźć", "ru": "ыэжюяшщ"}
# Names of languages, as an instruction may ask for them.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés",
    "de": "german|deutsch|allemand|alemán",
    "fr": "french|französisch|français|francés",
    "es": "spanish|spanisch|espagnol|español|castellano",
    "it": "italian|italienisch|italien|italiano",
    "pt": "portuguese|portugiesisch|portugais|portugués",
    "nl": "dutch|niederländisch|néerlandais|neerlandés",
    "pl": "polish|polnisch|polonais|polaco",
    "ru": "russian|russisch|russe|ruso",
}
# What stands in for a missing answer.
PLACEHOLDERS = "n/a|n\\.a\\.|na|none|null|nil|nan|undefined|unknown|empty|blank|tbd|todo|tba|pending|missing|no answer|not available|not applicable|no response|keine angabe|k\\. ?a\\.|keine antwort|sin respuesta|no disponible|aucune réponse|non disponible|s/o|\"\"|''|\\[\\]|\\{\\}|\\(\\)|<>|-+|–|—|\\.+|…|\\?+|_+|\\*+|x+|lorem ipsum|your answer here|answer|response|placeholder"
# How refusals open, and what they say they cannot or will not do (after a look at the first letter).
REFUSAL_OPENING = (
    r"^(?:i['’]?m sorry|i am sorry|sorry|i apologi[sz]e|apologies|unfortunately|regrettably|as an? (?:ai|artificial|large|language)|i appreciate|i understand|i (?:can['’]?t|cannot|can not|am unable|am not able|won['’]?t|will not|must decline|don['’]?t feel|do not feel|have to decline)|i['’]m (?:unable|not able|not comfortable)|this is something|answering this"
    r"|leider|es tut mir leid|tut mir leid|bedauerlicherweise|als (?:ki|sprachmodell|künstliche)|ich (?:kann|darf|bin nicht|muss ablehnen)|entschuldigung"
    r"|désolée?|je (?:suis désolée?|regrette|ne peux|ne suis|refuse|ne saurais)|malheureusement|en tant que (?:modèle|ia|qu['’])|excusez"
    r"|lo siento|lamentablemente|lamento|desafortunadamente|como (?:modelo|ia|asistente)|no (?:puedo|me es posible|estoy)|disculp|perd[oó]n)"
)
REFUSAL_ACT = (
    r"\b(?=[acdghimnruvw])(?:(?:can['’]?t|cannot|can not|unable to|not able to|won['’]?t be able to|will not|not allowed to|not permitted to)\s+(?:\w+\s+)?(?:help|assist|answer|provide|discuss|respond|comply|share|fulfil|support|do that|give)"
    r"|(?:must|have to|need to) (?:decline|refuse)|(?:against|violate) (?:my|our) (?:guidelines|policy|policies|rules)|(?:not|don['’]t) feel comfortable|not comfortable"
    r"|nicht (?:helfen|beantworten|weiterhelfen|bereitstellen|antworten|unterstützen)|nicht in der lage|(?:muss|möchte) ich ablehnen|gegen meine richtlinien"
    r"|(?:ne peux pas|ne suis pas en mesure|impossible|ne saurais|ne suis pas autorisée?)[^.]{0,40}(?:répondre|aider|fournir|assister|donner|satisfaire)|refuser de|contraire à mes"
    r"|(?:no puedo|no me es posible|no estoy en condiciones|no me está permitido)[^.]{0,40}(?:responder|ayudar|contestar|proporcionar|dar|ofrecer)|debo negarme|debo rechazar|contra mis (?:normas|directrices))"
)
QUESTION_LABEL = r"^\s*(?:question|q|instruction|prompt|task|frage|aufgabe|anweisung|pregunta|instrucción|tarea|consigna|demande|consigne|requête)\s*[:.\-–]\s*"

_TOKEN = re.compile(r"[^\W\d_]+|[¿¡]")
_CODE = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")
_BY_WORD: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_list.split()):
        _BY_WORD.setdefault(_w, []).append(_lang)
_BY_LETTER = {c: lang for lang, letters in LETTERS.items() for c in letters}


def language(text: str) -> tuple[str, float]:
    """(language, lead): the language of most function words and telling letters, and its lead over the next ("" with no evidence)."""
    votes: dict[str, float] = {}
    for word in _TOKEN.findall(_CODE.sub(" ", text).lower()):
        if word in _BY_WORD:
            for lang in (known := _BY_WORD[word]):
                votes[lang] = votes.get(lang, 0.0) + 1.0 / len(known)
        if not word.isascii():  # as every telling letter is
            for lang in {_BY_LETTER[c] for c in word if c in _BY_LETTER}:
                votes[lang] = votes.get(lang, 0.0) + 0.4
    first, second = (*sorted(votes.items(), key=itemgetter(1), reverse=True), ("", 0.0), ("", 0.0))[:2]
    return (first[0], first[1] - second[1]) if first[1] > 0 else ("", 0.0)


# Refusals that are planted for validation, by language; none of them is used by a labelling function as it stands.
PLANTED_REFUSALS = {
    "en": ("I'm afraid I can't help with that request.", "Sorry, but I am unable to answer this question.", "As an assistant I must decline to respond to it."),
    "de": ("Es tut mir leid, dabei kann ich nicht helfen.", "Leider bin ich nicht in der Lage, das zu beantworten."),
    "fr": ("Je suis désolé, je ne peux pas répondre à cette demande.", "Malheureusement, je ne suis pas en mesure de vous aider."),
    "es": ("Lo siento, no puedo responder a esa pregunta.", "Lamentablemente no me es posible ayudar con eso."),
}
# Empty answers that are planted for validation.
PLANTED_BLANKS = ("", "   ", "N/A", "null", "-", "...", "\u200b", "TBD")
#: Turns of planting: seven kinds, and as many rounds as give every variant of a kind the same share.
TURNS = 7 * 120


def plant(sample: pd.DataFrame, turns: list[int] | None = None, spoken: list[str] | None = None) -> pd.DataFrame:
    """``sample`` (i, o) with id and planted: a seventh of the rows each gets one defect, the rest stay sound ("").

    ``turns`` say which defect and variant a row gets (the row's number if not given). An answer in
    another language is the next one of the sample; with ``turns`` it is None, for the caller to fill.
    """
    spoken = [language(o)[0] for o in sample["o"]] if spoken is None else spoken
    planted, answers = [], []
    for n, (i, o) in enumerate(zip(sample["i"], sample["o"])):
        turn = n if turns is None else turns[n]
        kind, round_ = (*DEFECTS, "", "")[turn % 7], turn // 7
        if kind == "empty":
            o = PLANTED_BLANKS[round_ % len(PLANTED_BLANKS)]
        elif kind == "refusal":
            own = PLANTED_REFUSALS.get(spoken[n], PLANTED_REFUSALS["en"])
            o = own[round_ % len(own)]
        elif kind == "copied_question":
            o = (i, f"Question: {i}", f"{i} {i}")[round_ % 3]
        elif kind == "other_language":
            if not spoken[n] or len(o.split()) < 4:
                kind = ""
            elif turns is not None:
                o = None
            else:
                other = next((k for k in range(n + 1, n + len(sample)) if spoken[k % len(sample)] not in ("", spoken[n])), None)
                kind, o = (kind, sample["o"].iloc[other % len(sample)]) if other is not None else ("", o)
        elif kind == "truncated":
            at = len(o) * (4 + round_ % 5) // 10
            while at < len(o) - 1 and not (o[at - 1].isalpha() and o[at].isalpha()):
                at += 1
            kind, o = (kind, o[:at]) if len(o.split()) >= 8 and at < len(o) - 1 else ("", o)
        planted.append(kind)
        answers.append(o)
    return sample.assign(id=range(len(sample)), o=pd.Series(answers, index=sample.index, dtype=object), planted=planted)


_TOLD = {"i_lang": T.StringType(), "i_lead": T.DoubleType(), "o_lang": T.StringType(), "o_lead": T.DoubleType(), "planted": T.StringType(), "given": T.StringType(), "g_lang": T.StringType(), "g_lead": T.DoubleType()}


@F.pandas_udf(T.StructType([T.StructField(name, kind) for name, kind in _TOLD.items()]))
def told_of(i: pd.Series, o: pd.Series, turn: pd.Series) -> pd.DataFrame:
    """:func:`language` of questions and answers, and what :func:`plant` makes of the answers, where ``turn`` is not negative."""
    asked, spoken = [language(t) for t in i], [language(t) for t in o]
    out = {"i_lang": [x for x, _ in asked], "i_lead": [x for _, x in asked], "o_lang": [x for x, _ in spoken], "o_lead": [x for _, x in spoken]}
    planted, given = [""] * len(o), [None] * len(o)
    if (turn >= 0).all():
        made = plant(pd.DataFrame({"i": i, "o": o}), turn.tolist(), out["o_lang"])
        planted = made["planted"].tolist()
        given = [text if kind else None for kind, text in zip(planted, made["o"].tolist())]
    new = [language(t or "") for t in given]
    return pd.DataFrame(out | {"planted": planted, "given": pd.Series(given, dtype=object), "g_lang": [x for x, _ in new], "g_lead": [x for _, x in new]})


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``, else 0 where ``no``, else -1 (abstain)."""
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(0))).otherwise(F.lit(-1))


def labelling_functions() -> dict[str, dict[str, Column]]:
    """Votes by defect and function, over the columns that :func:`prepared` makes."""
    c = F.col
    novel = c("n_ow") - c("in_question")
    share_of_answer = c("in_question") / F.greatest(F.lit(1), c("n_ow"))
    share_of_question = c("in_question") / F.greatest(F.lit(1), c("n_iw"))
    spoken = (c("o_lang.lang") != "") & (c("i_lang.lang") != "")
    differs = spoken & (c("o_lang.lang") != c("i_lang.lang")) & (c("o_lang.lang") != c("asked"))
    said = c("n_ow") > 0
    shared = c("in_source") / F.greatest(F.lit(1), c("n_ow"))
    return {
        "empty": {
            "blank": _vote(c("bare") == ""),
            "placeholder": _vote(c("bare").rlike(f"^[(\\[<{{\"']?(?:{PLACEHOLDERS})[)\\]>}}\"'.]?$"), said),
            "no_word": _vote(~said),
            "tiny": _vote((c("bare") != "") & (c("n_ow") <= 2) & (F.length("bare") <= 12) & ~c("bare").rlike(r"\d") & (c("in_source") == 0), c("bare").rlike(r"\d") | (c("n_ow") >= 4)),
        },
        "refusal": {
            "opening": _vote(c("low").rlike(REFUSAL_OPENING), said),
            "act": _vote(c("low").rlike(REFUSAL_ACT), said),
            "detached": _vote(said & (c("content_in_source") <= 1) & ~c("low").rlike(r"\d") & (c("n_ow") >= 4), said & (c("low").rlike(r"\d") | (c("content_in_source") >= 4))),
        },
        "copied_question": {
            "covered": _vote((share_of_answer >= 0.85) & (share_of_question >= 0.7), said & ((share_of_answer < 0.75) | (share_of_question < 0.5))),
            "distance": _vote((F.length("qn") > 0) & (c("distance") <= F.length("qn") * 0.25), said & (c("distance") > F.length("qn") * 0.6) & (F.length(F.replace("on", "qn", F.lit(""))) > 0)),
            "repeated": _vote((F.length("qn") > 0) & (F.length("on") > 0) & (F.length(F.replace("on", "qn", F.lit(""))) <= F.length("qn") * 0.1), said & (novel >= 3)),
        },
        "other_language": {
            "function_words": _vote(differs & (c("o_lang.lead") >= 1.5) & (c("i_lang.lead") >= 0.8), spoken & (c("o_lang.lang") == c("i_lang.lang"))),
            "weak": _vote(differs, spoken & ~differs),
            "shared_words": _vote(differs & (c("n_ow") >= 4) & (shared <= 0.2), (c("o_lang.lang") == c("asked")) | (shared >= 0.5)),
        },
        "truncated": {
            "ending": _vote(c("score") >= 0.5, c("kind").isNull() | (c("score") < 0.3)),
            "open": _vote(c("kind").isin("tail", "fragment") & (c("n_words") >= 5), c("kind").isin("terminal", "empty", "value") | ((c("kind") == "fragment") & (c("n_words") <= 3) & (c("score") < 0.5))),
            "hanging": _vote(F.coalesce("hanging", F.lit(False)), c("kind").isin("terminal", "table", "value")),
        },
    }


def prepared(df: DataFrame, id_col: str, instruction: str, context: str, answer: str, planting: bool = False) -> DataFrame:
    """What the labelling functions read, one row a row with an id (own); with ``planting`` another one for its planted answer.

    planted is the defect of that answer, also where the answer is still to be given (another language).
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text(instruction).alias("i"), text(context).alias("c"), text(answer).alias("o"))
    invisible = r"[\s\p{Z}\p{Cc}\p{Cf}]"
    only_words = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")
    names = "|".join(LANGUAGE_NAMES.values())
    request = rf"\b(?:in|into|auf|en|ins)\s+({names})(?!\p{{L}})|(?<!\p{{L}})({names})\s+only"
    # a column of its own, so that the pattern runs once and not in every branch
    rows = rows.withColumn("named", F.regexp_extract(F.lower("i"), request, 0))
    rows = rows.withColumn("named", F.concat(F.regexp_extract("named", request, 1), F.regexp_extract("named", request, 2)))
    asked = F.lit("")
    for lang, own in LANGUAGE_NAMES.items():
        asked = F.when(F.col("named").isin(*own.split("|")), lang).otherwise(asked)
    turn = F.pmod(F.xxhash64("id"), F.lit(TURNS)) if planting else F.lit(-1)
    told = rows.select("id", F.xxhash64("i", "c", "o").alias("version"), "i", "c", "o", asked.alias("asked"), told_of("i", "o", turn).alias("told"))
    spoken = lambda lang, lead: F.struct(F.col(f"told.{lang}").alias("lang"), F.col(f"told.{lead}").alias("lead"))
    own = F.struct(F.lit(True).alias("own"), F.col("o"), spoken("o_lang", "o_lead").alias("o_lang"))
    given = F.struct(F.lit(False).alias("own"), F.col("told.given").alias("o"), spoken("g_lang", "g_lead").alias("o_lang"))
    # what the question and the context tell is the same for both answers
    both = told.select(
        "id",
        "version",
        F.col("told.planted").alias("planted"),
        "asked",
        F.array_distinct(words(F.col("i"))).alias("iw"),
        F.trim(only_words(F.col("i"))).alias("qn"),
        spoken("i_lang", "i_lead").alias("i_lang"),
        F.array_distinct(words(F.concat_ws(" ", "i", "c"))).alias("source"),
        F.when(F.col("told.given").isNull(), F.array(own)).otherwise(F.array(own, given)).alias("answers"),
    )
    rows = both.select(F.explode("answers").alias("a"), *[x for x in both.columns if x != "answers"]).select("*", "a.*").drop("a")
    out = rows.select(
        "*",
        # the end is the start of the reverse, which the pattern need not look for
        F.trim(F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(F.lower("o"), f"^{invisible}+", "")), f"^{invisible}+", ""))).alias("bare"),
        F.regexp_replace(F.lower("o"), f"^{invisible}+", "").alias("low"),
        F.array_distinct(words(F.col("o"))).alias("ow"),
        F.trim(only_words(F.regexp_replace(F.lower("o"), QUESTION_LABEL, ""))).alias("on"),
    )
    # far apart in length is far apart in edits, which spares most of the comparisons
    alike = (F.length("on") <= F.length("qn") * 1.6) & (F.length("on") >= F.length("qn") * 0.4)
    distance = F.when(F.col("on") == F.col("qn"), 0).when(alike, F.levenshtein("on", "qn")).otherwise(F.length("qn") + F.length("on"))
    out = out.withColumns({"shared": F.array_intersect("ow", "source"), "distance": distance})
    counted = {"in_question": F.size(F.array_intersect("ow", "iw")), "in_source": F.size("shared"), "content_in_source": F.size(F.filter("shared", lambda w: F.length(w) >= 6)), "n_ow": F.size("ow"), "n_iw": F.size("iw")}
    return out.withColumns(counted).drop("source", "shared", "ow", "iw")


@dataclass(frozen=True)
class LabelModel:
    """Rates of yes and no votes of each function among defective and sound pairs, and the share of defective ones."""

    prior: float
    yes_bad: np.ndarray
    no_bad: np.ndarray
    yes_good: np.ndarray
    no_good: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = votes == 1, votes == 0
        odds = np.log(self.prior / (1 - self.prior)) + yes @ np.log(self.yes_bad / self.yes_good) + no @ np.log(self.no_bad / self.no_good)
        return 1 / (1 + np.exp(np.clip(-odds, -500, 500)))


def fit(patterns: pd.DataFrame, rounds: int = 100) -> LabelModel:
    """A binary label model with conditionally independent votes, by expectation maximisation.

    ``patterns`` has one column of votes (1, 0, -1) a function and a count ``n``. Rates of yes and no
    votes are estimated in each class over all its pairs, so that functions that only ever say yes are
    judged as well; an abstention tells nothing. Priors say that functions are mostly right and
    defects rare.
    """
    votes = patterns.drop(columns="n").to_numpy()
    n = patterns["n"].to_numpy(dtype=float)
    yes, no = votes == 1, votes == 0
    k = votes.shape[1]
    model = LabelModel(0.05, np.full(k, 0.8), np.full(k, 0.1), np.full(k, 0.02), np.full(k, 0.8))
    for _ in range(rounds):
        post = model.posterior(votes)
        w, v = post * n, (1 - post) * n
        model = LabelModel((w.sum() + 1) / (n.sum() + 20), (w @ yes + 16) / (w.sum() + 20), (w @ no + 2) / (w.sum() + 20), (v @ yes + 2) / (v.sum() + 100), (v @ no + 80) / (v.sum() + 100))
    return model


def best_cutoff(posterior: np.ndarray, weight: np.ndarray, defective: np.ndarray) -> float:
    """The cutoff between 0.5 and 0.99 of the best F1; of several as good, the middle of the widest gap that gives it."""
    tried = np.unique(np.concatenate([[0.5, 0.99], posterior[(posterior > 0.5) & (posterior < 0.99)]]))
    tried = np.unique(np.concatenate([tried, (tried[1:] + tried[:-1]) / 2]))
    scores = []
    for t in tried:
        taken = posterior >= t
        right = float(weight[taken & defective].sum())
        scores.append(2 * right / max(1e-9, float(weight[taken].sum()) + float(weight[defective].sum())))
    good = tried[np.isclose(scores, max(scores))]
    return float((good[0] + good[-1]) / 2)


#: The fewest planted pairs of a defect that decide its cutoff.
LEAST_PLANTED = 20
#: About the sound pairs of a language that are numbered by one task.
NUMBERED = 10_000


def _voted(df: DataFrame, id_col: str, instruction: str, context: str, answer: str, statistics: tuple[DataFrame, DataFrame, DataFrame], planting: bool = False) -> DataFrame:
    """One row an id: version, lang, planted, an array of votes by defect, as given such arrays for the planted answer (null without one), and sound."""
    base = prepared(df, id_col, instruction, context, answer, planting)
    functions = labelling_functions()
    late = "truncated"  # its functions read the ending, which the corpus's lines explain
    about = ("version", "own", "planted", "lang")
    early = base.withColumn("lang", F.col("o_lang.lang")).select("id", *about, "o", *[F.array(*f.values()).alias(d) for d, f in functions.items() if d != late])
    features = ending_features(early, "id", "o", keep=(*about, *[d for d in functions if d != late]))
    hanging = F.col("last_word").isin(sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})) & F.col("kind").isin("tail", "fragment")
    judged = incomplete(features, statistics).withColumn("hanging", hanging)
    votes = judged.select("id", *about, *[F.array(*f.values()).alias(d) if d == late else F.col(d) for d, f in functions.items()])
    first = lambda values, which: F.min_by(F.when(which, F.struct(*values)), F.when(which, F.col("version")))
    one = votes.groupBy("id").agg(first(("version", "lang", "planted", *functions), F.col("own")).alias("v"), first(functions, ~F.col("own")).alias("given"))
    # sound: no function says yes
    return one.select("id", "v.*", "given").withColumn("sound", F.forall(F.flatten(F.array(*functions)), lambda v: v != 1))


def _patterns(voted: DataFrame, *by: str) -> pd.DataFrame:
    """by, defect, votes and how many rows (n): at most 81 a defect and value of ``by``."""
    functions = labelling_functions()
    # counted together first, so that few rows are taken apart
    together = voted.groupBy(*by, *functions).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in functions]))
    return together.select(*by, "n", each.alias("x")).groupBy(*by, "x.defect", "x.votes").agg(F.sum("n").alias("n")).toPandas()


def _in_other_languages(df: DataFrame, sound: DataFrame, id_col: str, instruction: str, context: str, answer: str) -> DataFrame | None:
    """(id, i, c, o): pairs whose turn it is, each with the answer of a sound pair in another language; None if all are in one.

    Answers are numbered by language and hash of the id. A pair takes one by its own hash among all
    that are not in its language, so every answer is as likely and no language is too rare.
    """
    spoken = sound.where(F.col("lang") != "").select("id", "version", "lang", "planted")
    number = {r["lang"]: r["count"] for r in spoken.groupBy("lang").count().collect()}
    if len(number) < 2:
        return None
    total, languages = sum(number.values()), sorted(number)
    of_language = lambda values: F.create_map(*[F.lit(x) for pair in zip(languages, values) for x in pair])[F.col("lang")].cast("long")
    start = of_language([sum(number[k] for k in languages[:n]) for n in range(len(languages))])
    # numbered inside parts of a language, which begin where the parts before them end
    parts = spoken.withColumn("h", F.xxhash64("id")).withColumn("part", F.pmod("h", F.lit(-(-total // NUMBERED))))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("lang", "part").count().select("lang", "part", (start + before).alias("begin"))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "id")) - 1
    numbered = parts.withColumn("within", within).join(starts, ["lang", "part"]).select((F.col("begin") + F.col("within")).alias("place"), F.col("id").alias("giver"), F.col("version").alias("giver_version"))
    mine = of_language([number[k] for k in languages])
    at = F.pmod(F.xxhash64("id", F.lit("other_language")), total - mine)
    taking = spoken.where(F.col("planted") == "other_language").select("id", "version", F.when(at < start, at).otherwise(at + mine).alias("place"))
    matched = taking.join(numbered, "place").drop("place")
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text(instruction).alias("i"), text(context).alias("c"), text(answer).alias("o"))
    rows = rows.withColumn("version", F.xxhash64("i", "c", "o"))
    key = ["giver", "giver_version"]
    answers = rows.select(F.col("id").alias("giver"), F.col("version").alias("giver_version"), "o").join(matched.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
    turn = F.pmod(F.xxhash64("id"), F.lit(TURNS)) % 7 == DEFECTS.index("other_language")
    questions = rows.where(turn).select("id", "version", "i", "c").join(matched.select("id", "version"), ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
    return matched.join(answers, key).select("id", "version", "o").join(questions, ["id", "version"]).select("id", "i", "c", "o")


def validated_cutoffs(df: DataFrame, voted: DataFrame, models: dict[str, LabelModel], id_col: str, instruction: str, context: str, answer: str, statistics: tuple[DataFrame, DataFrame, DataFrame]) -> dict[str, float]:
    """The cutoff of each defect, from all pairs for which no function says yes.

    A pair counts with the answer that its turn plants, or as it stands if none is planted. The
    planted and the other pairs are weighted by the share of defects that the model finds. A defect
    with too few planted pairs keeps 0.8.
    """
    names = list(models)
    sound = voted.where("sound")
    others = _in_other_languages(df, sound, id_col, instruction, context, answer)
    planted = F.when(F.col("given").isNull(), "").otherwise(F.col("planted")).alias("planted")
    kept = sound if others is None else sound.where(F.col("planted") != "other_language")
    rows = kept.select(planted, F.coalesce("given", F.struct(*names)).alias("votes")).select("planted", "votes.*")
    if others is not None:
        rows = rows.unionByName(_voted(others, "id", "i", "c", "o", statistics).select(F.lit("other_language").alias("planted"), *names))
    patterns = _patterns(rows, "planted")
    out = {}
    for defect, model in models.items():
        own = patterns[patterns["defect"] == defect]
        bad, n = (own["planted"] == defect).to_numpy(), own["n"].to_numpy(dtype=float)
        if n[bad].sum() < LEAST_PLANTED:
            out[defect] = 0.8
            continue
        posterior = model.posterior(np.array(own["votes"].tolist()))
        weight = n * np.where(bad, model.prior / n[bad].sum(), (1 - model.prior) / max(1, n[~bad].sum()))
        out[defect] = best_cutoff(posterior, weight, bad)
    return out


def find_defects(df: DataFrame, id_col: str = "record_id", instruction: str = "instruction", context: str = "context", answer: str = "expected_output") -> DataFrame:
    """(id, defect, posterior): every label whose posterior reaches its validated cutoff; a pair can have several.

    A null answer or instruction counts as empty; null ids are skipped; repeated rows of an id count
    once (of differing texts one is chosen by its hash); an empty table gives an empty result; other
    columns are ignored. The models are fitted on the counts of distinct vote patterns, of which there
    are at most 3^4 for a defect whatever the data's size; these counts, over all pairs and over all
    pairs of the validation, are all that reaches the driver.
    """
    statistics = line_statistics(df.select(F.col(answer).alias("o")), "o")
    voted = cut_lineage(_voted(df, id_col, instruction, context, answer, statistics, planting=True))
    models, patterns = {}, {}
    counts = _patterns(voted)
    for defect, own in labelling_functions().items():
        of_defect = counts[counts["defect"] == defect]
        if not of_defect.empty:
            patterns[defect] = pd.DataFrame([list(v) for v in of_defect["votes"]], columns=list(own)).assign(n=of_defect["n"].to_numpy())
            models[defect] = fit(patterns[defect])
    cutoffs = validated_cutoffs(df, voted, models, id_col, instruction, context, answer, statistics) if models else {}
    out = []
    for defect, model in models.items():
        votes = patterns[defect].drop(columns="n").to_numpy()
        kept = {",".join(map(str, v)): float(p) for v, p in zip(votes, model.posterior(votes)) if p >= cutoffs[defect]}
        if kept:
            table_of = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair])
            posterior = F.try_element_at(table_of, F.concat_ws(",", F.col(defect).cast("array<string>")))
            out.append(F.struct(F.lit(defect).alias("defect"), posterior.alias("posterior")))
    if not out:
        return voted.select("id", F.lit("").alias("defect"), F.lit(0.0).alias("posterior")).limit(0)
    return voted.select("id", F.explode(F.array(*out)).alias("x")).select("id", "x.*").where(F.col("posterior").isNotNull())


def p4_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of each record, with posteriors."""
    return find_defects(read_table(spark, sf_dir, "records")).withColumnRenamed("id", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, defect): the first of a record's defects in the order of precedence."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return find_defects(read_table(spark, sf_dir, "records")).groupBy(F.col("id").alias("record_id")).agg(F.min_by("defect", rank).alias("defect"))
