"""Sentence boundaries across scripts (problem 1).

The rules are the Unicode sentence-break rules over character properties (STerm, ATerm, Close, Sp,
SContinue), with three refinements: short forms, initials, decimals and list numbers do not end a
sentence; a pause of several dots does not; and a closing quotation mark decides whether the
sentence that quotes goes on behind it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# ---- fixed values: short forms whose full stop does not end a sentence, by language -------------
#: languages written in one script share their forms
SAME = {"mr": "hi", "ne": "hi", "sa": "hi"}
#: titles, "number", "rupees"
SHORT = {
    "hi": "डॉ डा प्रो कै सं रु श्रीम पं स्व मो ले मेज",
    "bn": "ডা ডঃ প্রো কৈ সং রু",
    "ta": "டா ப்ரோ கை ஸம் ரு",
    "gu": "ડૉ ડા પ્રો કૈ સં રુ",
    "pa": "ਡਾ ਡਾਂ ਪ੍ਰੋ ਕੈ ਸਂ ਸੰ ਰੁ",
    "kn": "ಡಾ ಪ್ರೋ ಕೈ ಸಂ ರು",
    "or": "ଡା ଡଃ ପ୍ରୋ କୈ ସଂ ରୁ",
    "ur": "ڈا پرو کے سں ر",
}
#: units of several parts; the parts may stand apart
UNITS = {
    "hi": "कि.मी से.मी मि.ग्रा मि.मी मि.ली कि.ग्रा",
    "bn": "কি.মী সে.মী মি.গ্রা কি.মি সে.মি",
    "ta": "கி.மீ ஸே.மீ மி.க்ரா",
    "gu": "કિ.મી સે.મી મિ.ગ્રા",
    "pa": "ਕਿ.ਮੀ ਸੇ.ਮੀ ਮਿ.ਗ੍ਰਾ",
    "kn": "ಕಿ.ಮೀ ಸೇ.ಮೀ ಮಿ.ಗ್ರಾ",
    "or": "କି.ମୀ ସେ.ମୀ ମି.ଗ୍ରା",
    "ur": "ک.می سے.می م.گرا",
}
#: names of Latin letters, as initials are written in other scripts
INITIALS = {
    "hi": "ए बी सी डी ई एफ जी एच आई जे के एल एम एन ओ पी क्यू आर एस टी यू वी डब्ल्यू एक्स वाई ज़ेड",
    "bn": "এ বি বী সি ডি ই এফ জি এইচ আই জে কে এল এম এন ও পি কিউ আর এস টি ইউ ভি",
    "ta": "ஏ பீ ஸீ டீ ஈ ஜீ ஜே கே ஏல ஏம ஏந ஓ பி ஆர ஏஸ வீ எம் ஆர்",
    "gu": "એ બી સી ડી ઈ એફ જી એચ આઈ જે કે એલ એમ એન ઓ પી આર એસ ટી યુ વી",
    "pa": "ਏ ਬੀ ਸੀ ਡੀ ਈ ਜੀ ਜੇ ਕੇ ਏਲ ਏਮ ਏਨ ਓ ਪੀ ਆਰ ਏਸ ਟੀ ਯੂ ਵੀ",
    "kn": "ಏ ಬೀ ಸೀ ಡೀ ಈ ಜೀ ಜೇ ಕೇ ಏಲ ಏಮ ಏನ ಓ ಪೀ ಆರ ಏಸ ಟೀ ಯೂ ವೀ",
    "or": "ଏ ବୀ ସୀ ଡୀ ଈ ଜୀ ଜେ କେ ଏଲ ଏମ ଏନ ଓ ପୀ ଆର ଏସ ଟୀ ଯୂ ଵୀ",
    "ur": "اے بی سی ڈی ای جی جے کے اےل اےم اےن او پی آر اےس ٹی یو وی",
}
#: names of letters that are also words a sentence may end with: honorifics, verbs, nouns
ALSO_WORDS = {
    "hi": "जी आई पी ई ओ",
    "mr": "जी आई पी ई ओ टी",
    "bn": "জি ই ও আই",
    "ta": "ஜீ ஈ ஓ",
    "gu": "જી આઈ પી ઈ ઓ",
    "pa": "ਜੀ ਪੀ ਈ ਓ ਸੀ",
    "kn": "ಜೀ ಈ ಓ",
    "or": "ଜୀ ଈ ଓ ପୀ",
    "ur": "جی ای او پی",
}
#: titles without a full stop, which stand before a name
TITLES = {
    "hi": "श्री सुश्री श्रीमती कुमारी",
    "bn": "শ্রী সুশ্রী শ্রীমতী",
    "ta": "ஸ்ரீ ஷ்ரீ ஸுஷ்ரீ",
    "gu": "શ્રી સુશ્રી શ્રીમતી",
    "pa": "ਸ਼੍ਰੀ ਸੁਸ਼੍ਰੀ ਸ਼੍ਰੀਮਤੀ",
    "kn": "ಶ್ರೀ ಸುಶ್ರೀ ಶ್ರೀಮತಿ",
    "or": "ଶ୍ରୀ ସୁଶ୍ରୀ ଶ୍ରୀମତୀ",
    "ur": "شری سشری",
}
#: "in" and "then": words before a name where nothing is spaced
BEFORE_NAME = {
    "hi": "में मध्ये मा तब",
    "bn": "তে তব",
    "ta": "இல் தப",
    "gu": "માં તબ",
    "pa": "ਵਿਚ ਤਬ",
    "kn": "ಅಲ್ಲಿ ತಬ",
    "or": "ମେଂ ତବ",
    "ur": "مےں تب",
}
#: Latin short forms, which texts of every language use
LATIN_SHORT = """
Dr Prof Mr Mrs Ms Capt Col Gen Lt Maj Sgt St Sr Jr Rev Hon No Nos Vol Fig Eq Sec Ch pp Rs Re Ltd
Inc Co Corp Dept Univ Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec vs etc approx ca cf e.g i.e
""".split()
#: those that are also words and count only before a number
BEFORE_NUMBER = ("No", "Nos", "Re", "Mar", "Sec", "Fig")
# ---- end of fixed values -----------------------------------------------------------------------


def _forms(words: list[str]) -> set[str]:
    """Each word also as typed on keyboards with other letters of the same look."""
    out = set(words)
    for seen, other in (("ک", "ك"), ("ی", "ي"), ("ہ", "ه")):
        out |= {w.replace(seen, other) for w in out}
    return out


def _class(prop: str) -> str:
    """The characters of a property, as a class for ``re``."""
    has = regex.compile(rf"(?V1){prop}")
    return "".join(map(re.escape, has.findall("".join(map(chr, [*range(0x21, 0xD800), *range(0xE000, 0x110000)])))))


_STERM, _ATERM = _class(r"\p{SB=STerm}"), _class(r"\p{SB=ATerm}")
FAR = re.compile("[\U00010000-\U0010ffff]")


def _by_plane(make) -> tuple[re.Pattern, re.Pattern]:
    """A pattern made from STerm and ATerm characters: for texts within the basic plane, where ``re`` is
    faster without the others, and for all."""
    return re.compile(make(FAR.sub("", _STERM), FAR.sub("", _ATERM))), re.compile(make(_STERM, _ATERM))


RUN = _by_plane(lambda s, a: f"[{s}{a}|…]+")
OPENING = "\"'“”‘’«»()[]{}<>*_-–—,;:₹$/"
DIGITS = "0123456789०१२३४५६७८९০১২৩৪৫৬৭৮৯۰۱۲۳۴۵۶۷۸۹"
NUMBER_BEHIND = regex.compile(r"(?V1)\s?[\p{Nd}IVXLC]+(?!\p{L})")
_longest = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))


class Forms:
    """The short forms of one language; of all languages where it is not known or has none of its own."""

    def __init__(self, lang: str | None):
        known = SAME.get(lang or "", lang)
        words = lambda table: _forms([w for k, v in table.items() if known not in SHORT or k == known for w in v.split()])
        # words of a language that shares its forms with others are its own
        also = _forms(ALSO_WORDS[lang].split()) if lang in ALSO_WORDS else words(ALSO_WORDS)
        short, initials, titles = words(SHORT), words(INITIALS), words(TITLES)
        units = {tuple(w.rsplit(".", 1)) for w in words(UNITS)}
        self.kept = short | initials | set(LATIN_SHORT) | {w.lower() for w in LATIN_SHORT if len(w) > 2 and w not in ("Col", "Fig", "Sec", "Vol", "Mar", "Nos")}
        self.unsure, self.before_number = also & initials, frozenset(BEFORE_NUMBER)
        self.before_name = titles
        self.units, self.first, self.last = units, {a for a, _ in units}, {b for _, b in units}
        self.unit_behind = re.compile(rf"\s?(?:{_longest(self.last)})\.")
        glued = short | {".".join(u) for u in units} | self.first
        before = titles | words(BEFORE_NAME)
        self.unspaced = regex.compile(rf"(?V1)(?:(?:{_longest(glued)})|(?<=^|[.।॥۔|?!؟\"“«(\p{{Nd}}]|{_longest(before)})(?:{_longest(initials)}))$")
        # no form reaches farther back than that from its full stop
        self.far = max(map(len, glued | initials)) + max(map(len, before)) + 1
        self.near = 2 * max(map(len, self.kept)) + 4


@lru_cache(maxsize=64)
def forms_of(lang: str | None) -> Forms:
    return Forms(lang)


def _short_form(text: str, begin: int, i: int, spaced: bool, forms: Forms) -> bool:
    """Whether the full stop at ``i`` belongs to a short form, an initial or a part of a unit; the sentence begins at ``begin``."""
    if not spaced:
        if forms.unspaced.search(text, max(0, i - forms.far), i):
            return True
    from_ = max(begin, i - forms.near)
    token = text[from_:i].rsplit(None, 1)
    if not token or text[i - 1].isspace():
        return False
    head, _, last = token[-1].rpartition(".")
    last = last.lstrip(OPENING)
    if last in forms.before_number:
        return NUMBER_BEHIND.match(text, i + 1) is not None
    if last in forms.unsure and not head:
        # a word, unless a name is under way: at the beginning, behind a title or another short form
        before = token[0].rsplit(None, 1)[-1] if len(token) == 2 and token[0].strip() else ""
        if before and not before.endswith(".") and before.lstrip(OPENING) not in forms.before_name:
            return False
    if last in forms.kept or (len(last) == 1 and LATIN_LETTER.match(last)):
        return True
    if last in forms.first and forms.unit_behind.match(text, i + 1):
        return True
    if last in forms.last:
        before = head.rpartition(".")[2].lstrip(OPENING + DIGITS)
        if not before and len(token) == 2:
            before = token[0].rsplit(None, 1)[-1].strip(".").lstrip(OPENING + DIGITS)
        return (before, last) in forms.units
    return False


#: What may stand behind the terminators and still closes the sentence: a verse number, more
#: terminators, closing marks.
VERSE = regex.compile(r"(?V1)[\s\u00a0]*[(\[]?\p{Nd}{1,5}[)\]]?[\s\u00a0]*[॥।]+")
MORE = _by_plane(lambda s, _: rf"\s*[{s}|]+|\.(?=[\s\"'”’»)]|$)")
CLOSE = regex.compile(r"(?V1)(?:[\p{Pe}\p{Pf}\"'\u200b\u2060\ufeff\u00ad])")
SPACES = regex.compile(r"(?V1)[\s\u00a0\u200b\u2060\ufeff\u00ad]*")
GOES_ON = regex.compile(r"(?V1)[,;:،؛–—\-、，]")
LATE_CLOSE = re.compile(r"\s+[\"”»](?=[\s,]|$)")
QUOTE = re.compile("[\"“”«»]")
END_MARK = _by_plane(lambda s, _: rf"[{s}|]|\.(?!\.)")
DASH = re.compile(r"[\-–—]\s")
LIST_NUMBER = regex.compile(r"(?V1)[\s\p{Ps}\p{Pi}\"'\u200b\u2060\ufeff\u00ad]*\p{Nd}{1,3}[.)]?$")
WORDY = regex.compile(r"(?V1)[\p{L}\p{N}]")
LATIN_UPPER = regex.compile(r"(?V1)[\p{Lu}&&\p{Latin}]")
LATIN_LETTER = regex.compile(r"(?V1)[\p{Latin}\p{Greek}\p{Cyrillic}]")


def _quotes(text: str, begin: int, end: int) -> tuple[bool, int]:
    """Whether a quotation is open at ``end`` in the sentence from ``begin``, and where it opened."""
    at, open_ = -1, False
    for m in QUOTE.finditer(text, begin, end):
        if m[0] in "“«" or (m[0] == '"' and not open_):
            open_, at = True, m.start()
        else:
            open_ = False
    return open_, at


DOTS = ".．․"
UNSEEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
WIDE = regex.compile(r"[\uff01-\uff5e]")
#: Indic letter A followed by the sign AA, which is drawn as the letter AA
SPLIT_AA = {chr(0x905 + o) + chr(0x93E + o): chr(0x906 + o) for o in range(0, 0x480, 0x80)}
#: letters of Indic and Arabic blocks that composition takes apart or puts together
_NOT_NFC = "".join(c for c in map(chr, range(0x600, 0xE00)) if unicodedata.normalize("NFC", c) != c)
UNUSUAL = re.compile(f"[\u00ad\u200b-\u200f\u2060\ufeff\uff01-\uff5e{_NOT_NFC}]")
PAIRS_OF_BLOCK: dict[int, list[str]] = {}


def _block(c: str) -> int:
    """The block of an Indic letter; 0 for the Arabic script."""
    return ord(c[0]) >> 7 if ord(c[0]) >= 0x900 else 0


for _c in map(chr, range(0x600, 0xE00)):
    _d = unicodedata.normalize("NFD", _c)
    if len(_d) == 2 and unicodedata.normalize("NFC", _c) == _c:
        PAIRS_OF_BLOCK.setdefault(_block(_c), []).append(_d)
for _p in SPLIT_AA:
    PAIRS_OF_BLOCK.setdefault(_block(_p), []).append(_p)
SCRIPT = re.compile("[\u0620-\u06d3\u0900-\u0963\u0971-\u0dff]")
CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}+")


def plain(text: str) -> tuple[str, list[int] | None]:
    """``text`` with unseen signs dropped and letters in their composed form, and each one's offset."""
    if text.isascii():
        return text, None
    if not UNUSUAL.search(text):
        m = SCRIPT.search(text)
        if m is None or not any(p in text for p in PAIRS_OF_BLOCK.get(_block(m[0]), ())):
            return text, None
    out: list[str] = []
    offsets: list[int] = []
    kept = [i for i, c in enumerate(text) if not UNSEEN.match(c)]
    seen = "".join(unicodedata.normalize("NFKC", text[i]) if WIDE.match(text[i]) else text[i] for i in kept)
    for m in CLUSTER.finditer(seen):
        c = unicodedata.normalize("NFC", m[0])
        c = SPLIT_AA.get(c[:2], c[:2]) + c[2:]
        out.append(c)
        offsets += [kept[min(m.start() + x, m.end() - 1)] for x in range(len(c))]
    return "".join(out), offsets


def spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Start and end of each sentence in ``text``, white space around a sentence left out.

    Short forms are those of ``lang``, of all languages where it is null or unknown. Null or blank text has none. Text without any terminator is one sentence. Offsets are those of
    the stored text, also where it holds unseen signs or decomposed letters.
    """
    if text is None or not text.strip():
        return []
    seen, offsets = plain(text)
    if offsets is None:
        return _spans(text, lang)
    if not seen.strip():
        begin = len(text) - len(text.lstrip())
        return [(begin, len(text.rstrip()))]
    starts = [offsets[a] for a, _ in _spans(seen, lang)]
    first = len(text) - len(text.lstrip())
    out = []
    for k, a in enumerate(starts):
        a = first if k == 0 else a
        # unseen signs right before a sentence open it
        while k and a > 0 and UNSEEN.match(text[a - 1]):
            a -= 1
        out.append(a)
    return [(a, len(text[: b].rstrip())) for a, b in zip(out, [*out[1:], len(text)])]


def is_spaced(text: str) -> bool:
    """Whether the words of ``text`` are parted by white space, not only its sentences."""
    return len(text.split()) * 14 > len(text)


def _spans(text: str, lang: str | None) -> list[tuple[int, int]]:
    spaced, forms = is_spaced(text), forms_of(lang)
    run_of, more, end_mark = (x[FAR.search(text) is not None] for x in (RUN, MORE, END_MARK))
    cuts, begin, n = [], 0, len(text)
    pos, quotes = 0, QUOTE.search(text) is not None
    while (m := run_of.search(text, pos)) is not None:
        i, j = m.span()
        pos, run = j, m[0]
        if run.endswith("...") or run in ("..", "…"):
            # a pause; a terminator before it still counts
            run = run.rstrip("…")
            run = run[: len(run) - 3] if run.endswith("...") else run.rstrip(".")
            if not run:
                continue
        dot = run[0] in DOTS and len(run) == 1
        if dot:
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if before.isdigit() and (after.isdigit() or LIST_NUMBER.fullmatch(text, begin, i) and after):
                continue
            if _short_form(text, begin, i, spaced, forms):
                continue
            if after.isalpha() and before.isalpha() and LATIN_LETTER.match(before) and LATIN_LETTER.match(after) and not (before.islower() and after.isupper()):
                continue
        elif "|" in run and LATIN_LETTER.match(text[:i].rstrip()[-1:] or " "):
            continue
        if text[j : j + 1] == " " and "॥" not in run and "।।" not in run and not (quotes and QUOTE.search(text, begin, j)):
            c = text[j + 1 : j + 2]
            if c.isalpha() and not c.islower():  # the usual case: a space and a letter, no quotation
                cuts.append(j)
                begin = j
                continue
        while k := more.match(text, j):
            j = k.end()
        if ("॥" in run or "।।" in run) and (k := VERSE.match(text, j)):
            j = k.end()
        # closing marks, each only where it closes something
        open_, at = _quotes(text, begin, i) if quotes else (False, -1)
        quoted = False
        while j < n and CLOSE.match(text, j):
            c = text[j]
            if c in '"“”«»':
                if c == '"' and not open_:
                    break
                quoted, open_ = open_, False
            elif c == "'" and text.count("'", begin, j) % 2 == 0:
                break
            j += 1
        if open_ and (k := LATE_CLOSE.match(text, j)):
            j, quoted, open_ = k.end(), True, False
        s = SPACES.match(text, j).end()
        if s >= n:
            pos = j
            continue
        c = text[s]
        if quoted and end_mark.match(text, s):
            pos = s  # the terminator behind the quotation ends the sentence
            continue
        if GOES_ON.match(text, s) and not DASH.match(text, s):
            continue
        if quoted and WORDY.search(text, begin, at) and not LIST_NUMBER.fullmatch(text, begin, at):
            # the quotation stands inside the sentence: a question or exclamation lets it go on
            if any(x in run for x in "?!؟") and not c.isupper():
                continue
        if c.islower() and (dot or quoted) and LATIN_LETTER.search(text, max(begin, i - 3), i) and LATIN_UPPER.search(text):
            continue
        cuts.append(j)
        begin = pos = j
    out: list[tuple[int, int]] = []
    for a, b in zip([0, *cuts], [*cuts, n]):
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        if lead == len(piece):
            continue
        span = (a + lead, a + len(piece.rstrip()))
        if out and span[1] - span[0] < 12 and not WORDY.search(text, *span):
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
    if len(out) > 1 and not WORDY.search(text, *out[0]):
        out[:2] = [(out[0][0], out[1][1])]
    return out


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(SPANS)
def sentence_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, langs in batches:
        yield pd.Series([[{"start": a, "end": b} for a, b in spans(t, g)] for t, g in zip(texts, langs)], dtype=object)


# marked so that Spark does not evaluate it once more for a filter that it pushes below or infers
sentence_spans = sentence_spans.asNondeterministic()


def sentences(df: DataFrame, text: str | Column, *keys: str, lang: str | Column | None = None) -> DataFrame:
    """``keys`` plus ``sent_no`` (from 0), ``start_char``, ``end_char`` and ``sentence``, a row per sentence.

    ``lang`` is the column with the language of each text (``hi``, ``bn``, ...); where it is null, or none is given, the
    short forms of all languages count. Rows whose text is null or blank give no row. Repeated rows are split each on
    its own. Columns of ``df`` other than ``keys`` are dropped, so names cannot clash.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    own = F.lit(None).cast("string") if lang is None else col(lang)
    return (
        df.select(*keys, col(text).alias("_t"), own.alias("_l"))
        .withColumn("_s", sentence_spans("_t", "_l"))
        .select(*keys, "_t", F.posexplode("_s").alias("sent_no", "_p"))
        .select(*keys, "sent_no", F.col("_p.start").alias("start_char"), F.col("_p.end").alias("end_char"), F.expr("substring(_t, _p.start + 1, _p.end - _p.start)").alias("sentence"))
    )
