"""Texts that look the same but differ in characters, brought to one form (problem 6).

A text is cut at its spaces into tokens. Almost every token is plain: it holds no sign that could look like
another. The others walk a trie of the stored spellings with a weighted edit automaton: look-alike letters
and signs that are not seen cost nothing, every visible edit costs more than may be spent. Of the spellings
reached the cleanest, then the most frequent is canonical. A token that reaches none takes the form of the table.

Shards of the trie are cut by a skeleton: the number of letters and digits and the first few of them, without
marks, joiners and punctuation. Words of one skeleton may look quite different; the automaton tells.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from granthika.operators.skew import skew_join
from granthika.session import cut

# ---- fixed values ------------------------------------------------------------------------------
#: signs that are not seen: soft hyphen, zero-width space, word joiner, byte-order mark, marks of
#: direction, invisible operators, variation selectors
IGNORED = "\u00ad͏\u061c\u180e\u200b\u200e\u200f\u2060\u2061\u2062\u2063\u2064︀︁︎️\ufeff"
JOINERS = "\u200c\u200d"
#: spaces that look like a space
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: letters that look like a Latin one: Cyrillic, then Greek
ALIKE = {
    **dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYXGQWYaesijopcyxdqwhl")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj")),
}
#: Arabic letters and the Urdu or Persian ones that are drawn alike
ARABIC = dict(zip("كيىهۃ", "کییہة"))
#: signs drawn alike: hyphens, apostrophe, the bar and the danda
SIGNS = dict(zip("‐‑ʼ|", "--'।"))

VIRAMAS = "्্੍્୍்్್്"
#: Arabic letters that join on neither side or only to the letter before
NOT_JOINING_ON = "اآأإٱدڈذرڑزژوؤۇۆۈۋےۓةء"
#: independent vowels and the sequences that are drawn like them, by Indic block
SPLIT_VOWELS = {}
for _o in range(0x900, 0xD80, 0x80):
    for _seq, _one in (("\x05\x3e", "\x06"), ("\x05\x4b", "\x13"), ("\x05\x4c", "\x14"), ("\x05\x49", "\x11"), ("\x0f\x47", "\x10")):
        _chars = [chr(_o + ord(c)) for c in _seq + _one]
        if all(unicodedata.category(c) != "Cn" for c in _chars):
            SPLIT_VOWELS["".join(_chars[:2])] = _chars[2]
SPLIT_VOWELS["।।"] = "॥"  # two dandas and the double danda
JOINED_VOWELS = {v: k for k, v in SPLIT_VOWELS.items()}
ONE = {**ALIKE, **ARABIC, **SIGNS, **{chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFDD), *range(0xFFE0, 0xFFE7)] if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}}
TABLE = str.maketrans({**ONE, **dict.fromkeys(IGNORED), **dict.fromkeys(SPACES, " ")})
SPLIT = re.compile("|".join(SPLIT_VOWELS))


def _visible_joiner(text: str, i: int) -> bool:
    """Whether the joiner at ``i`` changes how the letters beside it are drawn."""
    b = next((c for c in reversed(text[:i]) if c not in IGNORED and c not in JOINERS), "")
    a = next((c for c in text[i + 1 :] if c not in IGNORED and c not in JOINERS), "")
    if not b or not a:
        return False
    if b in VIRAMAS or a in VIRAMAS:
        return True
    if "\u0600" <= b < "ހ" and "\u0600" <= a < "ހ":
        joins = unicodedata.category(a)[0] == "L" and unicodedata.category(b)[0] == "L" and b not in NOT_JOINING_ON and a != "ء"
        return joins and text[i] == "\u200c"
    return False


def fold(token: str) -> str:
    """The table's form of a token: unseen signs dropped, wide and look-alike characters replaced by
    the ordinary ones, spaces made one kind, letters composed. Folding twice changes nothing more."""
    while True:
        before = token
        if any(j in token for j in JOINERS):
            token = "".join(c for i, c in enumerate(token) if c not in JOINERS or _visible_joiner(token, i))
        token = unicodedata.normalize("NFC", token.translate(TABLE))
        token = unicodedata.normalize("NFC", SPLIT.sub(lambda m: SPLIT_VOWELS[m[0]], token))
        if token == before:  # a sign that fell away may have brought others together
            return token


ODD = re.compile("[" + "".join(map(re.escape, sorted(set(ONE) | set(IGNORED) | set(JOINERS)))) + "]")
#: a Latin letter right beside a Greek or Cyrillic one
MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0300-\u036f]*[\u0370-\u03ff\u0400-\u052f]|[\u0370-\u03ff\u0400-\u052f][\u0300-\u036f]*[A-Za-z\u00c0-\u024f]")


def is_odd(text: str) -> bool:
    """Whether ``text`` may look like something else; where it is false, it is its own form."""
    return bool(ODD.search(text)) or not unicodedata.is_normalized("NFC", text) or bool(SPLIT.search(text)) or bool(MIXED.search(text))


def is_clean(token: str) -> bool:
    """Whether a spelling is the one to prefer: nothing unseen, nothing replaced, no scripts mixed."""
    return fold(token) == token and not MIXED.search(token)


# ---- the automaton -----------------------------------------------------------------------------
#: what an edit costs that is seen
VISIBLE = 1
UNSEEN = frozenset(IGNORED)
#: stands for a joiner that changes nothing beside it
NO_JOINER = "\u200b"


def parts(token: str) -> str:
    """Characters taken apart, so that composed and separate letters are the same sequence."""
    return "".join(JOINED_VOWELS.get(c, c) for c in unicodedata.normalize("NFD", token))


def symbols(token: str) -> str:
    """What the automaton reads: the token taken apart, joiners that change nothing as unseen signs."""
    marked = "".join(c if c not in JOINERS or _visible_joiner(token, i) else NO_JOINER for i, c in enumerate(token))
    out = parts(marked)
    if (bare := "".join(c for c in marked if c not in UNSEEN)) != marked and parts(bare) != "".join(c for c in out if c not in UNSEEN):
        return parts(bare)  # an unseen sign had kept marks apart that have an order
    return out


def trie(spellings: list[str]) -> dict:
    """A trie of spellings; a node has its words under the empty string, its unseen signs under "unseen"."""
    root: dict = {}
    for s in spellings:
        node = root
        for c in symbols(s):
            child = node.get(c)
            if child is None:
                child = node[c] = {}
                if c in UNSEEN:
                    node.setdefault("unseen", []).append(child)
            node = child
        node.setdefault("", []).append(s)
    return root


@lru_cache(maxsize=1 << 14)
def looks(c: str) -> str:
    """The character that stands for all that look like ``c``."""
    while (d := ONE.get(c, c)) != c:
        c = d
    return c


LIKE: dict[str, list[str]] = {}
for _c in ONE:
    LIKE.setdefault(looks(_c), [looks(_c)]).append(_c)


def substitution(a: str, b: str) -> int:
    """0 for the same character or look-alikes, else the cost of a visible edit."""
    return 0 if a == b or looks(a) == looks(b) else VISIBLE


def reach(root: dict, token: str, most: int = 0) -> list[tuple[int, str]]:
    """Cost and spelling of all words in the trie within a cost of ``most`` from ``token``.

    The automaton's states are places in trie and token, taken cheapest first. Substituting a look-alike and
    dropping or adding an unseen sign (a joiner only where it changes nothing) cost nothing, every other
    edit ``VISIBLE``.
    """
    word = symbols(token)
    n = len(word)
    out: list[tuple[int, str]] = []
    queue, tick, done = [(0, 0, 0, root)], 0, set()
    while queue:
        cost, _, at, node = heapq.heappop(queue)
        if (id(node), at) in done:
            continue
        done.add((id(node), at))
        steps = [(0, at, child) for child in node.get("unseen", ())]
        if at == n:
            out.extend((cost, s) for s in node.get("", ()))
        else:
            c = word[at]
            if c in UNSEEN:
                steps.append((0, at + 1, node))
            steps += [(0, at + 1, child) for x in LIKE.get(looks(c), (c,)) if (child := node.get(x)) is not None]
        if cost + VISIBLE <= most:
            if at < n:
                steps.append((VISIBLE, at + 1, node))
                steps += [(VISIBLE, at + 1, child) for x, child in node.items() if len(x) == 1 and substitution(word[at], x)]
            steps += [(VISIBLE, at, child) for x, child in node.items() if len(x) == 1]
        for more, to, child in steps:
            tick += 1
            heapq.heappush(queue, (cost + more, tick, to, child))
    return out


def choose(found: list[tuple[int, str]], counts: dict[str, int], token: str) -> str:
    """The canonical spelling among those reached: the cheapest, of these a clean one, then the most frequent, then
    the least. Where nothing was reached, or only spellings with signs that the table would take out, the
    table's form stands; it never parts what the automaton has brought together, as it is the same for all."""
    usable = [x for x in found if is_clean(x[1]) or (MIXED.search(fold(x[1])) and not MIXED.search(x[1]))]
    return min(usable, key=lambda x: (x[0], not is_clean(x[1]), -counts.get(x[1], 0), x[1]))[1] if usable else fold(token)


# ---- shards ------------------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _skeleton_letters() -> tuple[str, str]:
    """Letters and digits that stand for others in a skeleton, and for which; those beyond the second list's end
    fall away. A rule over all characters: the first part of what is taken apart, as what it looks like."""
    of: dict[str, str] = {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x110000)]):
        d = unicodedata.decomposition(c)
        if unicodedata.category(c)[0] in "LN" and (c in ONE or c in JOINED_VOWELS or (d and d[0] != "<")):
            b, a = "", c
            while a != b:
                b, a = a, looks(parts(a)[:1])[:1]
            if a != c:
                of[c] = a if unicodedata.category(a)[0] in "LN" else ""
    order = sorted(of, key=lambda c: (of[c] == "", c))
    return "".join(order), "".join(of[c] for c in order)


def skeleton(token: Column, first: int = 3) -> Column:
    """The number of letters and digits of a token and the first of them; the same for all that look alike."""
    letters = F.translate(F.regexp_replace(token, r"[^\p{L}\p{N}]+|\p{IsHangul}", ""), *_skeleton_letters())
    return F.concat(F.length(letters).cast("string"), F.lit(":"), F.substring(letters, 1, first))


def _match(key: tuple, asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Canonical spellings of one shard's odd tokens, by its trie of spellings. Where a stored spelling is not clean
    its clean form is a word of the trie too."""
    counts = dict(zip(words["token"], words["n"]))
    clean = {f for t in counts if is_odd(t) and is_clean(f := fold(t))}
    root = trie(sorted(clean.union(counts)))
    return pd.DataFrame({"token": asked["token"], "spelling": [choose(reach(root, t), counts, t) for t in asked["token"]]}, dtype=object)


TOKENS = ArrayType(StructType([StructField("pos", IntegerType()), StructField("token", StringType())]))


@F.pandas_udf(TOKENS)
def odd_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The odd tokens of a text and their places among all; most texts have none."""
    for series in texts:
        yield series.map(lambda t: [] if t is None or not is_odd(t) else [{"pos": k, "token": w} for k, w in enumerate(t.split(" ")) if is_odd(w)])


@F.pandas_udf(StringType())
def respelled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A text with the tokens at the given places in their canonical spelling."""

    def one(text: str, made: list) -> str:
        words = text.split(" ")
        for m in made:
            words[m["pos"]] = m["s"]
        return " ".join(words)

    for texts, mades in batches:
        yield pd.Series([one(t, m) for t, m in zip(texts, mades)], dtype=object)


# marked so that Spark does not evaluate them once more where their columns are used
odd_tokens, respelled = odd_tokens.asNondeterministic(), respelled.asNondeterministic()


def spaced(text: Column) -> Column:
    """``text`` with all spaces that look like a space made one."""
    return F.translate(text, SPACES, " " * len(SPACES))


def _looked_at(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, raw, odd, text``: the digest of each text as it stands, its odd tokens, and the text, its spaces
    made one kind. Null and blank texts are left out."""
    some = F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)
    return texts.where(some).select(*keys, F.unhex(F.md5("text")).alias("raw"), spaced(F.col("text")).alias("text")).withColumn("odd", odd_tokens("text"))


def forms(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, raw, form, odd, text``: ``form`` is the digest of a text that is plain; only of the others the text is kept."""
    plain = F.size("odd") == 0
    t = _looked_at(texts, *keys)
    return t.select(*keys, "raw", F.when(plain, F.unhex(F.md5("text"))).alias("form"), F.when(~plain, F.col("odd")).alias("odd"), F.when(~plain, F.col("text")).alias("text"))


def spellings(asked: DataFrame, vocabulary: DataFrame, shards: int | None = None) -> DataFrame:
    """``token, spelling`` for every one of the ``asked`` tokens (column ``token``, each once).

    Of the vocabulary (``text``) the tokens enter a trie that share their skeleton with an asked one; a token and all
    that looks like it meet in one shard, and a hot spelling is one row.
    """
    shards = shards or int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.where("token is not null").withColumn("skeleton", skeleton(F.col("token")))
    words = vocabulary.select(F.explode(F.split(spaced(F.col("text")), " ", -1)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = words.withColumn("skeleton", skeleton(F.col("token"))).join(asked.select("skeleton").distinct(), "skeleton", "left_semi")
    shard = F.pmod(F.xxhash64("skeleton"), F.lit(shards)).alias("shard")
    return asked.select("token", shard).groupBy("shard").cogroup(known.select("token", "n", shard).groupBy("shard")).applyInPandas(_match, "token string, spelling string")


def rebuild(odd_texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``digest, canonical`` for the distinct ``odd_texts`` (``text, odd``): every odd token in its canonical spelling.

    Only odd tokens are joined, the hot ones among them salted; texts are told apart by their digests.
    """
    each = cut(odd_texts.select(F.unhex(F.md5("text")).alias("digest"), "text", "odd").dropDuplicates(["digest"]))
    tokens = each.select("digest", F.explode("odd").alias("o")).select("digest", "o.pos", "o.token")
    counts = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    spelled = spellings(counts.select("token"), vocabulary)
    made = skew_join(tokens, spelled, ["token"], F.struct("digest", "pos"), counts).groupBy("digest").agg(F.collect_list(F.struct("pos", F.col("spelling").alias("s"))).alias("made"))
    return each.join(made, "digest").select("digest", respelled("text", "made").alias("canonical"))


def consistent(texts: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """``keys, text, canonical``: every text (column ``text``) in the one form of all that look like it.

    Plain texts are their own form. Null and blank texts come out with a null form. Repeated rows stay.
    """
    t = cut(texts.select(*keys, "text").withColumn("_s", spaced(F.col("text"))).withColumn("_odd", odd_tokens("_s")))
    hard = t.where(F.size("_odd") > 0).withColumn("digest", F.unhex(F.md5("_s")))
    own = _looked_at(vocabulary.select("text")).where(F.size("odd") > 0)
    made = rebuild(hard.select(F.col("_s").alias("text"), F.col("_odd").alias("odd")).unionByName(own.select("text", "odd")), vocabulary)
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    easy = t.where(F.size("_odd") == 0).select(*keys, "text", F.when(~blank, F.col("_s")).alias("canonical"))
    return easy.unionByName(skew_join(hard, made, ["digest"], F.struct(*keys) if keys else F.col("text")).select(*keys, "text", "canonical"))


def look_alikes(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts that are no stored text but look like one: ``tbl, rec_id, match_id``, each once.

    ``texts`` has ``tbl, rec_id, text``, ``stored`` ``tbl, match_id, text``; only the same ``tbl`` is compared.
    Null and blank texts match nothing; letter case, the number of spaces, digits of another script,
    and joiners that change the letters count as visible. A text alike to several stored ones
    gives a row for each. Further columns are ignored.
    """
    a = cut(forms(texts, "tbl", "rec_id"))
    b = cut(forms(stored, "tbl", "match_id"))
    hard = a.select("text", "odd").unionByName(b.select("text", "odd")).where("text is not null")
    made = cut(rebuild(hard, stored).select("digest", F.unhex(F.md5("canonical")).alias("made")))

    def whole(df: DataFrame, key: str) -> DataFrame:
        odd = df.where("text is not null").withColumn("digest", F.unhex(F.md5("text")))
        return df.where("text is null").select("tbl", key, "raw", "form").unionByName(skew_join(odd, made, ["digest"], F.col(key)).select("tbl", key, "raw", F.col("made").alias("form")))

    ca, cb = whole(a, "rec_id"), whole(b, "match_id")
    # only texts that are themselves no stored text
    itself = cb.select("tbl", "raw").distinct()
    mine = cut(ca.join(itself, ["tbl", "raw"], "left_anti").select("tbl", "form", "rec_id"))
    return skew_join(mine, cb.select("tbl", "form", "match_id"), ["tbl", "form"], F.col("rec_id")).select("tbl", "rec_id", "match_id").distinct()
