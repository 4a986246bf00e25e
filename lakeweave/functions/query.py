"""What users ask: greetings, several questions in one, frustration, spelling, context for an answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import ABBREVIATIONS
from .text import collapse_punctuation, shouting

# What people greet with.
GREETINGS = ("hi", "hey", "hello", "hi there", "hey there", "hello there", "good morning", "good afternoon", "good evening", "thanks", "thank you")
# Words that begin a question, words that begin a request, openers of one more question.
QUESTION_WORDS = ("what", "why", "how", "who", "where", "when", "which")
REQUEST_WORDS = ("explain", "describe", "tell", "show", "list", "define", "compare", "summarize")
OPENERS = (("also",), ("additionally",), ("as", "well", "as"), ("in", "addition"))
# Words of urgency and rudeness; a caller may give others.
URGENT = ("right now", "as soon as possible", "asap", "urgent", "urgently", "immediately", "emergency", "hurry", "now")
RUDE = ("damn", "hell", "crap", "sucks", "stupid")
RUDER = ("shit", "fuck", "fucking", "bullshit", "asshole")
# Weights of the signs of frustration.
WEIGHTS = {"shouting": 0.25, "punctuation": 0.20, "urgency": 0.25, "profanity": 0.40}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it: lambdas are not searched for what they have in common."""
    return F.transform(F.array(value), then)[0]


def tokens(text: Column) -> Column:
    """Array of words and single marks: said (with the white space before it), low (bare, in lower case), gap (whether white space stands before it)."""
    found = F.regexp_extract_all(text, F.lit(r"(\s*(?:\w+|[^\w\s]))"), 1)
    bare = lambda t: F.ltrim(t, F.lit(" \t\n\x0b\f\r"))  # noqa: E731  what \s is
    return F.transform(found, lambda t: F.struct(t.alias("said"), F.lower(bare(t)).alias("low"), (t != bare(t)).alias("gap")))


def _in_view(text: Column) -> Column:
    """Each token with its two neighbours before (b, a) and two after (n, m); null where there is none."""
    at = lambda t, i, k: F.get(t, i + k)
    return _let(tokens(text), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("t"), at(t, i, -1).alias("a"), at(t, i, -2).alias("b"), at(t, i, 1).alias("n"), at(t, i, 2).alias("m"))))


def _is(low: Column, words) -> Column:
    return F.coalesce(low.isin(*words), F.lit(False))


def _opens(x: Column) -> Column:
    """Whether a token begins an opener; its last words are looked up only where the first fits."""
    out = F.lit(False)
    for words in OPENERS:
        fits = F.lit(True)
        for place, word in zip("tnm", words, strict=False):
            fits = fits & _is(x[place]["low"], [word])
        out = out | fits
    return out


def _sentence_before(x: Column) -> Column:
    """Whether a sentence's dot stands before a token: one after a word of two letters or more that is no abbreviation."""
    return F.coalesce(x["t"]["gap"] & (x["a"]["low"] == ".") & ~x["a"]["gap"] & F.regexp_like(x["b"]["low"], F.lit(r"^\w{2,}$")) & ~_is(x["b"]["low"], ABBREVIATIONS), F.lit(False))


def _long(low: Column) -> Column:
    return F.coalesce(F.regexp_like(low, F.lit(r"^\w{4,}$")), F.lit(False))


def _capital(said: Column) -> Column:
    return F.coalesce(F.regexp_like(said, F.lit(r"^\s*[A-Z]")), F.lit(False))


def _greets(piece: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(piece), r"[\s!?.,]+", " ")).isin(*GREETINGS)


def _pieces(text: Column) -> Column:
    """A text between marks that white space follows: each piece with its mark, and the mark before it."""
    every = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[!?.,]) ")
    return _let(every, lambda own: F.transform(own, lambda p, i: F.struct(p.alias("piece"), F.coalesce(F.right(F.get(own, i - 1), F.lit(1)), F.lit("")).alias("mark"))))


def multi_part(text: Column) -> Column:
    """Whether a text asks more than one thing.

    Signs, read off its tokens: a second question mark; two question words or two requests in a line; an opener such as
    "also"; a sentence that another follows, told by long words on both sides or by a capital; a greeting before more.
    """
    return _let(collapse_punctuation(F.coalesce(text, F.lit(""))), _several)


def _several(q: Column) -> Column:
    lines = F.transform(F.split(q, r"[\n\r]+"), lambda line: F.regexp_extract_all(F.lower(line), F.lit(r"(\w+)"), 1))
    twice = lambda words: _let(lines, lambda every: F.exists(every, lambda own: F.size(F.filter(own, lambda w: w.isin(*words))) > 1))

    def follows(x: Column) -> Column:
        mark = _is(x["a"]["low"], (".", "!", "?")) & ~x["a"]["gap"] & x["t"]["gap"]
        return F.coalesce(mark & (_long(x["b"]["low"]) & _long(x["t"]["low"]) | F.regexp_like(x["b"]["low"], F.lit(r"^\w{3,}$")) & _capital(x["t"]["said"])), F.lit(False))

    rest = lambda own: F.array_join(F.transform(F.slice(own, F.lit(2), F.size(own)), lambda p: p["piece"]), " ")
    greeted = _let(_pieces(q), lambda own: _greets(own[0]["piece"]) & F.regexp_like(own[0]["mark"], F.lit("^$")) & F.regexp_like(rest(own), F.lit("[A-Za-z0-9]")))
    return (F.regexp_count(q, F.lit(r"\?")) > 1) | twice(QUESTION_WORDS) | twice(REQUEST_WORDS) | F.coalesce(greeted, F.lit(False)) | F.exists(_in_view(q), lambda x: _opens(x) | follows(x))


def without_greeting(text: Column) -> Column:
    """A text without the pieces between marks that only greet: the first, the last, those after a sentence, or all there is. White space is folded where there are several pieces."""
    kept = lambda pieces: F.filter(pieces, lambda p, i: ~(_greets(p["piece"]) & ((p["mark"] != ",") | (i == F.size(pieces) - 1))))
    said = lambda q, pieces, own: F.when(F.size(own) == F.size(pieces), F.regexp_replace(q, r"\s+", " ")).otherwise(F.array_join(F.transform(own, lambda p: p["piece"]), " "))
    return _let(F.trim(F.coalesce(text, F.lit(""))), lambda q: _let(_pieces(q), lambda pieces: _let(kept(pieces), lambda own: said(q, pieces, own))))


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def has_greeting(text: Column) -> Column:
    return without_greeting(text) != _folded(text)


def parts(text: Column) -> Column:
    """A question's parts. One ends after ? and !, after a greeting, at a sentence's dot before a capital or between long words, before an opener after a mark, and at "and" before another question or request."""
    q = collapse_punctuation(F.trim(F.coalesce(text, F.lit(""))))

    def step(acc: Column, x: Column) -> Column:
        t, a, b = x["t"], x["a"]["low"], x["b"]["low"]
        greeted = _is(a, (".",)) & _greets(acc["now"])
        sentence = _sentence_before(x) & (_capital(t["said"]) | _long(b) & _long(t["low"]))
        cut = t["gap"] & _is(a, (".", "?", "!", ",")) & (_is(a, ("?", "!")) | greeted | sentence | _is(a, (".", "?", ",")) & _opens(x))
        joined = (t["low"] == "and") & t["gap"] & _is(x["n"]["low"], (*QUESTION_WORDS, *REQUEST_WORDS))
        ended = lambda said: F.struct(F.when(F.trim(acc["now"]) != "", F.concat(acc["done"], F.array(F.trim(acc["now"])))).otherwise(acc["done"]).alias("done"), said.alias("now"))
        return F.when(cut, ended(t["said"])).when(joined, ended(F.lit(""))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], t["said"]).alias("now")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(_in_view(q), start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(F.trim(acc["now"]))), lambda p: p != ""))


def _any(words: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


def _may_hold(text: Column, words: tuple[str, ...]) -> Column:
    """False only where none of the words can be found: a plain word is looked for without a pattern first."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) if re.fullmatch(r"[\w ]+", w) else F.lit(True) for w in words), F.lit(False))


def _less(word: str) -> Callable[[Column], Column]:
    """Counts a phrase in what is left of a text, and takes it out."""

    def step(f: Column) -> Column:
        hits = f["hits"] + F.regexp_count(f["rest"], F.lit(_any((word,))))
        return F.when(_may_hold(f["rest"], (word,)), F.struct(hits.alias("hits"), F.regexp_replace(f["rest"], _any((word,)), "\x01").alias("rest"))).otherwise(f)

    return step


def frustration(text: Column, urgent: tuple[str, ...] = URGENT, rude: tuple[str, ...] = RUDE, ruder: tuple[str, ...] = RUDER) -> dict[str, Column]:
    """shouting, punctuation, urgency, profanity (0 to 1 each) and score: their weighted sum, 0.5 at least for heavy profanity, 1 at most."""
    q = F.coalesce(text, F.lit(""))
    low = F.lower(q)
    # a longer phrase is counted and taken out before a shorter one can match within it
    found = F.struct(F.lit(0).alias("hits"), low.alias("rest"))
    for word in sorted(urgent, key=len, reverse=True):
        found = _let(found, _less(word))
    hits = found["hits"]
    runs = F.regexp_extract_all(q, F.lit(r"([!?]{2,})"), 1)
    excess = F.aggregate(runs, F.lit(0.0), lambda s, r: s + (F.length(r) - 1) * F.when(F.contains(r, F.lit("!")), 1.0).otherwise(0.5))
    has = lambda words: _let(low, lambda own: _may_hold(own, words) & own.rlike(_any(words)))
    heavy = has(ruder)
    signs = {"shouting": shouting(q), "punctuation": F.least(F.lit(1.0), excess / 5), "urgency": F.least(F.lit(1.0), hits / 2.0), "profanity": F.when(heavy, 1.0).when(has(rude), 0.6).otherwise(0.0)}
    total = sum((signs[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return signs | {"score": F.least(F.lit(1.0), _let(total, lambda t: F.when(heavy, F.greatest(t, F.lit(0.5))).otherwise(t)))}


def frustration_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "moderate").when(score >= 0.2, "mild").otherwise("none")


def corrected(text: Column, corrections: dict[str, str]) -> Column:
    """Words put right by a fixed table (lower case); others stay. Spelling by a dictionary is ``suggest``."""
    table = F.create_map(*(F.lit(x) for kv in corrections.items() for x in kv)) if corrections else F.create_map().cast("map<string,string>")
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}'-]+|[^\p{L}\p{N}'-]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), "")


def suggest(words: DataFrame, dictionary: DataFrame, within: int = 2) -> DataFrame:
    """(word, suggestion): itself if the dictionary has it, else the nearest entry by edits (then alphabet), else itself.

    Candidates share the word with up to ``within`` letters deleted, found by equality.
    """
    def deletes(c: Column, n: int) -> Column:
        out = F.array(c)
        for _ in range(n):
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))))
        return out

    left = words.select("word", F.explode(deletes(F.lower("word"), within)).alias("k"))
    right = dictionary.select("entry", F.explode(deletes(F.lower("entry"), within)).alias("k"))
    near = left.join(right, "k").select("word", "entry").distinct().withColumn("d", F.levenshtein(F.lower("word"), F.lower("entry"))).filter(F.col("d") <= within)
    best = near.groupBy("word").agg(F.min_by("entry", F.struct("d", "entry")).alias("s"))
    return words.select("word").distinct().join(best, "word", "left").select("word", F.coalesce("s", "word").alias("suggestion"))


def greeting_reply(text: Column) -> Column:
    """Which reply a bare greeting gets."""
    return F.when(text.rlike(r"(?i)\bthank"), "welcome").when(text.rlike(r"(?i)good\s+morning"), "morning").when(text.rlike(r"(?i)good\s+(afternoon|evening)"), "evening").otherwise("hello")


def analyze(queries: DataFrame, corrections: dict[str, str] | None = None) -> DataFrame:
    """query_id, query and its analysis: frustration on the raw text, then spelling, marks, greeting, parts and segments."""
    raw = F.coalesce(F.col("query"), F.lit(""))
    # one projection after the other, since a column that several others are made of is not computed again for each
    df = queries.withColumns({"frustration": frustration(raw)["score"], "corrected": collapse_punctuation(corrected(raw, corrections or {}))})
    df = df.withColumn("bare", without_greeting(F.col("corrected"))).withColumns({"multi_part": multi_part(F.col("bare")), "_split": parts(F.col("bare"))})
    several, split = F.col("multi_part"), F.col("_split")
    segments = F.when(F.col("bare") == "", F.array().cast("array<string>")).when(several & (F.size(split) > 1), split).otherwise(F.array("bare"))
    made = {"greeting": F.col("bare") != _folded(F.col("corrected")), "split_ok": F.size(split) > 1, "needs_model_split": several & (F.size(split) <= 1) & (F.col("bare") != ""), "segments": segments}
    return df.withColumns(made).select(*queries.columns, "frustration", "corrected", "greeting", "bare", "multi_part", "split_ok", "needs_model_split", "segments")


def context(df: DataFrame) -> Column:
    """Lines that tell a model how the question was understood."""
    return F.concat_ws("\n", F.concat(F.lit("frustration: "), frustration_level(F.col("frustration"))), F.concat(F.lit("greeting: "), F.col("greeting").cast("string")), F.concat_ws("\n", F.transform("segments", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))))


def intents(segments: DataFrame, by: str = "query_id", label: str = "label") -> DataFrame:
    """(by, intents): distinct labels, GREETING first, the others by name."""
    return segments.groupBy(by).agg(F.transform(F.array_sort(F.collect_set(F.struct((F.col(label) != "GREETING").alias("o"), F.col(label).alias("l")))), lambda s: s["l"]).alias("intents"))
