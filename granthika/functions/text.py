"""Text functions as column expressions; one place for the patterns that engines read differently."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granthika.sources.tables import SPACE, strip

# ---- fixed values: they decide results and are stated as they are -------------------------------
#: letters, ASCII digits and the whole Devanagari block, danda included
TOKEN = "[0-9A-Za-zऀ-ॿ]+"
#: the encoder's: letters, marks and numbers of every script
ENCODER_TOKEN = r"[\p{L}\p{M}\p{N}]+"
SENTENCE_ENDS = "।॥.!?"
LEAST_SENTENCE = 15
ABBREVIATIONS = "Mr|Mrs|Dr|St|Jr|Sr|vs|etc|No|Inc|Ltd"
STOPWORDS = """
की का के को में से पर और या यह वह जो कि ने भी एक है हैं था थे थी हो होता होती होने
तक ही तो लिए करने किया कर रहा रहे रही अपने इस उस कोई कुछ सब बहुत नहीं
the a an is are was were be been being in on at of and or to for that this these those
it its as by with from not no any some all more most very there their they them he she
""".split()
LABELS = ["उत्तर", "जवाब", "answer", "ans", "note", "reply", "response", "output", "a"]
HARM = r"\b(how to (make|build|synthesi[sz]e) (a )?(bomb|explosive|weapon|poison|nerve agent)|kill (myself|yourself|him|her|them)|commit suicide|child (porn|abuse|sexual)|(buy|sell|make) (meth|heroin|fentanyl))\b"
INJECTION = r"(ignore (all )?(previous|prior|above) instructions|disregard (the )?(system|previous) (prompt|instructions)|you are now a\b|reveal (your )?(system )?prompt|show me your (system )?(prompt|instructions)|repeat (the )?(text )?above|act as (if you are|an?) )"
MONEY_SIGNS = "$₹€£"
MONEY_WORDS = "rupees|dollars|crore|lakh"
#: least length of a word that must stand in the sources word for word
RARE = 4


def words(text: Column) -> Column:
    """Words between white space; an empty or blank text has none, null stays null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats kept; a null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def encoder_tokens(text: Column) -> Column:
    """Lower-case tokens for the hashed encoder, of all scripts, repeats kept; a null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENCODER_TOKEN), F.lit(0)), F.lower)


def stopwords() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def content_tokens(text: Column) -> Column:
    """Distinct tokens that are no stop words."""
    return F.array_except(tokens(text), stopwords())


def content_id(text: Column) -> Column:
    """16 hex digits of SHA-256: the same text has the same id."""
    return F.substring(F.sha2(text, 256), 1, 16)


@F.pandas_udf(StringType())
def blake_id(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """16 hex digits of BLAKE2b, for ids that must agree with stores written that way."""
    for series in texts:
        yield series.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest())


def split_pieces(text: Column) -> Column:
    """Pieces between sentence ends followed by white space, stripped, empty ones dropped."""
    parts = F.split(text, rf"(?<=[{SENTENCE_ENDS}]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_sentences(text: Column, least: int = LEAST_SENTENCE) -> Column:
    """Sentences of a text: a piece that is short, or follows an abbreviation, joins the one before.

    Whether a piece opens a sentence depends only on itself and the piece before, so no fold is
    needed. A blank text has no sentence, a null text none either.
    """

    def grouped(p: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(1), F.size(p)),
            lambda i: (i == 1) | ~((F.length(F.element_at(p, i)) < least) | F.element_at(p, F.greatest(i - 1, F.lit(1))).rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])({ABBREVIATIONS})\.$")),
        )
        ends = lambda s: F.transform(s, lambda x, k: F.array_join(F.slice(p, x, F.coalesce(F.get(s, k + 1), F.size(p) + 1) - x), " "))
        return F.transform(F.array(opens), ends)[0]

    pieces = F.coalesce(split_pieces(text), F.array().cast("array<string>"))
    return F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, grouped(p)).otherwise(F.array().cast("array<string>")))[0]


def content_tags(text: Column) -> Column:
    """``date`` for a year, ``money`` for a currency, else ``numeric`` for any digit, else ``text``."""
    edge = lambda inner: rf"(?<![\p{{L}}\p{{N}}_])({inner})(?![\p{{L}}\p{{N}}_])"
    date = text.rlike(edge("1[0-9]{3}|20[0-9]{2}"))
    money = text.rlike(rf"(?i)[{MONEY_SIGNS}]|{edge(MONEY_WORDS)}")
    number = text.rlike(r"\p{Nd}")
    tags = F.array(F.when(date, "date"), F.when(money, "money"), F.when(number & ~date & ~money, "numeric"), F.when(~number & ~date & ~money, "text"))
    return F.filter(tags, lambda t: t.isNotNull())


def normalize_answer(text: Column) -> Column:
    """``text`` without emphasis marks and without a leading label such as "Answer:"."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[*_`~]+", "")
    label = rf"^{SPACE}*({TOKEN[:-1]}{{1,20}}){SPACE}*[:：]{SPACE}*"
    is_label = F.lower(F.regexp_extract(t, label, 1)).isin(LABELS)
    return strip(F.when(is_label, F.regexp_replace(t, label, "")).otherwise(t))


def screen(text: Column) -> Column:
    """``empty_query``, ``unsafe_input`` or ``ok``."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    unsafe = text.rlike("(?i)" + HARM) | text.rlike("(?i)" + INJECTION)
    return F.when(blank, "empty_query").when(unsafe, "unsafe_input").otherwise("ok")


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's content tokens that the context tokens have; 0 for an answer without any.

    ``context`` is an array of all tokens of the sources."""
    own = content_tokens(answer)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, context)) / F.size(own)).otherwise(F.lit(0.0))


def violations(answer: Column, context: Column) -> Column:
    """Numbers and long content words of the answer that the context does not have, sorted."""
    new = F.array_except(tokens(answer), context)
    stop = stopwords()
    return F.sort_array(F.filter(new, lambda t: t.rlike("^[0-9]+$") | (~F.array_contains(stop, t) & (F.length(t) >= RARE))))


def numbered_context(texts: Column, question: Column) -> Column:
    """The texts numbered from 1, a blank line between them, and the question below."""
    numbered = F.transform(texts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))
    return F.concat(F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), question)
