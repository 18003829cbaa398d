"""Text decoded with the wrong character encoding, found and restored (problem 10).

A best-first search over repair steps. A step takes one encoding back (characters that could be the bytes of
UTF-8 sequences are encoded with it and decoded as UTF-8), reads words that were read in one single-byte
encoding in another, or unescapes references and escaped bytes. No step reaches over ASCII characters, so a text is searched
by its runs of other characters: a state is a set of runs that the same steps have changed, and whether a step
has enough to show for it is judged over all of them. The cost of a run counts characters that are implausible
where they stand, and the steps taken; states seen before are known by hash.

The cheapest state is taken first, also where it costs more than the one before, and a run is left alone once
no further step can lead to a cheaper one than its best. Every step makes a run shorter or takes
implausible words out of it, so there is no limit on states or steps.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: encodings that text is commonly mistaken for; the bytes that the Windows ones leave undefined
#: count as the control characters of the same number
CODECS = ("latin-1", "cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-2", "cp1256")
#: East Asian encodings: the characters are pairs of bytes
PAIRED = ("gbk", "big5", "shift_jis", "euc_kr")
#: what words are read in by mistake, and what they were written in: alphabets other than Latin
MISREAD = ("cp1252", "latin-1", "mac_roman")
WRITTEN = ("cp1251", "koi8-r", "cp866", "cp1253", "cp1255", "cp1256")
ORDER = {c: i for i, c in enumerate(CODECS)}
STEP_COST = 0.5
#: what a lost character costs; no step brings it back
LOST = 2.0
#: so many sequences must be found in these alphabets, and so many with a sign among the letters,
#: before words are taken for bytes
ALPHABETS = ("cp1251", "cp866", "koi8-r", "cp1256")
LEAST_OF_LETTERS = 3
FIXED = StructType([StructField("garbled", BooleanType()), StructField("text", StringType()), StructField("steps", StringType()), StructField("cost", DoubleType()), StructField("lost", IntegerType())])


def _table(codec: str) -> dict[int, str]:
    """The character of each byte from 0x80 on."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _chars(table: dict[int, str], low: int, high: int) -> str:
    return "".join(re.escape(table[b]) for b in range(low, high + 1))


TABLES = {c: _table(c) for c in CODECS}
BYTES = {c: {ord(ch): b for b, ch in t.items()} for c, t in TABLES.items()}
SEQUENCE = {
    c: re.compile(f"[{_chars(t, 0xC2, 0xDF)}][{k}]|[{_chars(t, 0xE0, 0xEF)}][{k}]{{2}}|[{_chars(t, 0xF0, 0xF4)}][{k}]{{3}}")
    for c, t in TABLES.items()
    for k in [_chars(t, 0x80, 0xBF)]
}
#: two and more escaped bytes, and escaped characters
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){2,}")
BACKSLASH = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){2,}|(?:\\u[0-9A-Fa-f]{4})+")
#: letters with marks, four and more in a row: no word in Latin letters has them
ACCENTED = re.compile("[\u00aa\u00b5\u00ba\u00c0-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192]{4,}")
#: in other alphabets: a capital behind a small letter, five consonants in a row
UNWORDLY = re.compile("[\u0430-\u045f\u03ac-\u03ce][\u0400-\u042f\u0386-\u03ab]|(?i:[бвгджзйклмнпрстфхцчшщ]{5}|[βγδζθκλμνξπρστφχψ]{5})")
#: what steps work on: anything but ASCII, references, escapes
RUN = re.compile(r"(?:[^\x00-\x7f]+|&(?:amp;)*#?[A-Za-z0-9]{2,31};|(?:%[0-9A-Fa-f]{2}){2,}|(?:\\[xu][0-9A-Fa-f]{2,4})+)+")
#: small letters of an alphabet are words as long as there is nothing else
SMALL = re.compile("[А-Я]?[а-я]+$")
#: vowels, of which the likelier of two alphabets has more
VOWELS = re.compile("(?i:[аеёиоуыэюяєії]|[αεηιουωάέήίόύώ])")
EASTERN = re.compile("[\u3000-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff00-\uffef]{2,}")
REFERENCE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,31}\d{0,2});")


@lru_cache(maxsize=1 << 16)
def _plausible(c: str) -> bool:
    """Whether a restored character is one that text has: letters and marks of living scripts,
    common punctuation, currency and typographic signs."""
    o = ord(c)
    if 0x900 <= o < 0xE00 or 0x600 <= o < 0x700:
        return unicodedata.category(c) != "Cn"
    if 0xA0 <= o < 0x180:
        return True
    if 0x2010 <= o <= 0x203A or o in (0x20AC, 0x20B9, 0x2122, 0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060, 0x2007, 0x202F, 0x2212):
        return True
    if 0x370 <= o < 0x530 or 0x1E00 <= o < 0x2000:
        return unicodedata.category(c)[0] == "L"
    if 0x80 <= o < 0xA0:  # a stage of text garbled twice; the cost sees to it that none is left
        return True
    # the same: signs that the bytes of UTF-8 become
    return any(o in BYTES[k] for k in ("cp1252", "mac_roman", "cp437", "cp1251"))


#: the first two bytes of Indic and of Arabic letters, as the Western and the Arabic encoding show them
HALF = "\u00e0[\u00a4-\u00b7]|[\u0637\u0638\u0639\u063a\u00d8-\u00db][\u00a0-\u00bf\u201a-\u2122]"
_COUNTED = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250", "cp866", "koi8-r")
_LEADS = "".join(sorted({re.escape(TABLES[c][b]) for c in _COUNTED for b in range(0xC2, 0xF5)}))
#: one look at the first character settles most places
PAIR = re.compile(f"(?=[{_LEADS}\u0637\u0638\u0639\u063a])(?:" + "|".join(SEQUENCE[c].pattern for c in _COUNTED) + f"|{HALF})")
#: letters of an alphabet right beside those of an Indic or Arabic script
MIXED = re.compile("[\u0600-\u06ff\u0900-\u0dff][\u00c0-\u02af\u0370-\u052f]|[\u00c0-\u02af\u0370-\u052f][\u0600-\u06ff\u0900-\u0dff]")
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


def cost(text: str) -> float:
    """Implausible characters of a text: each control character and lost character, and each sign
    that stands in a sequence which would be a character's bytes."""
    total = sum(len(m) for m in PAIR.findall(text) if not SMALL.match(m)) + 2.0 * len(CONTROL.findall(text)) + 2.0 * len(MIXED.findall(text)) + LOST * text.count("\ufffd") + 2.0 * len(REFERENCE.findall(text))
    total += sum(len(m) for m in ACCENTED.findall(text)) + 2.0 * len(UNWORDLY.findall(text))
    if "%" in text or "\\" in text:
        total += sum(2.0 * len(m) for e in (PERCENT, BACKSLASH) for m in e.findall(text) if _unescaped(m) != m)
    if EASTERN.search(text):
        total += sum(2.0 * len(m) for m in EASTERN.findall(text) if any(_eastern(m, c) for c in PAIRED))
    return total


def _unescaped(m: str) -> str:
    """What escaped bytes or characters stand for, where that is more than ASCII; else the escapes."""
    if m.startswith("\\u"):
        try:
            out = bytes.fromhex(m.replace("\\u", "")).decode("utf-16-be")
        except UnicodeDecodeError:
            return m
    else:
        try:
            out = bytes.fromhex(m.replace("%", "").replace("\\x", "")).decode("utf-8")
        except UnicodeDecodeError:
            return m
    return m if out.isascii() or not all(c.isascii() or _plausible(c) for c in out) else out


@lru_cache(maxsize=1 << 12)
def _eastern(run: str, codec: str) -> str:
    """What pairs of bytes read in ``codec`` are as UTF-8, "" for nothing plausible; a last byte may be lost."""
    try:
        out = run.encode(codec).decode("utf-8", "replace")
    except UnicodeEncodeError:
        return ""
    kept = out[:-1] if out.endswith("\ufffd") else out
    return out if len(kept) > 1 and "\ufffd" not in kept and all(c.isascii() or _plausible(c) for c in kept) and any(not c.isascii() for c in kept) else ""


def _reread(run: str, read: str, written: str) -> str:
    """A run of characters read in one single-byte encoding as what it is in another, if that is a word."""
    try:
        out = bytes(BYTES[read][ord(c)] for c in run).decode(written)
    except (KeyError, UnicodeDecodeError):
        return run
    return out if all(c.isalpha() for c in out) else run


#: what each sequence met so far stands for, "" for nothing plausible
MEMO: dict[str, dict[str, str]] = {c: {} for c in CODECS}


def _decoded(sequence: str, codec: str) -> str:
    try:
        c = bytes(BYTES[codec][ord(x)] for x in sequence).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return ""
    return c if _plausible(c) else ""


def takes_back(text: str, codec: str) -> dict[str, str]:
    """The sequences of ``text`` that are a character's UTF-8 bytes in ``codec``, and the character. A few sequences made of
    letters alone are words, and count for nothing."""
    memo, n, signs = MEMO[codec], 0, 0
    taken: dict[str, str] = {}
    for sequence in SEQUENCE[codec].findall(text):
        c = memo.get(sequence)
        if c is None:
            if len(memo) > 50_000:
                memo.clear()
            c = memo[sequence] = _decoded(sequence, codec)
        if c:
            n += 1
            taken[sequence] = c
            # letters with two signs right behind them are no word, nor is a small letter with a capital behind it
            odd = len(sequence) > 2 and (not any(x.isalpha() for x in sequence[1:]) or (sequence[0].islower() and sequence[1].isupper()))
            signs += LEAST_OF_LETTERS if odd else not sequence.isalpha()
    enough = signs >= (LEAST_OF_LETTERS if codec in ALPHABETS else 1) or (n >= LEAST_OF_LETTERS and codec != "cp1256")
    return taken if enough else {}


def _steps(text: str, evidence: str) -> Iterator[tuple[str, str]]:
    """Every step from ``text``, runs one to a line: its name and what it leads to. ``evidence`` has each run as often
    as it occurs, so far as that may matter."""
    taken = {c: t for c in CODECS if (t := takes_back(evidence, c))}
    for codec, t in taken.items():
        # not tried: an encoding that takes back only what another one takes back too, the same way
        rivals = (u for c, u in taken.items() if c != codec and (len(u) > len(t) or (len(u) == len(t) and ORDER[c] < ORDER[codec])))
        if not any(t.items() <= u.items() for u in rivals):
            yield codec, SEQUENCE[codec].sub(lambda m: t.get(m[0], m[0]), text)  # noqa: B023
    if not taken and ACCENTED.search(text):  # only where nothing is the bytes of UTF-8
        for read in MISREAD:
            for written in WRITTEN:
                yield f"{read}/{written}", ACCENTED.sub(lambda m: _reread(m[0], read, written), text)  # noqa: B023
    if EASTERN.search(text):
        for codec in PAIRED:
            yield codec, EASTERN.sub(lambda m: _eastern(m[0], codec) or m[0], text)  # noqa: B023
    if "&" in text:
        yield "unescape", REFERENCE.sub(lambda m: html.unescape(m[0]), text)
    if "%" in text:
        yield "percent", PERCENT.sub(lambda m: _unescaped(m[0]), text)
    if "\\" in text:
        yield "backslash", BACKSLASH.sub(lambda m: _unescaped(m[0]), text)


def _search(counts: Counter[str]) -> dict[str, tuple[float, str, tuple[str, ...]]]:
    """For each run the cheapest that steps lead to: its cost, the run, and the steps. Of several ways that cost the same
    the one is taken that leaves fewest characters, then the one by which most of the text is won."""
    start = {r: cost(r) for r in counts}
    best = {r: (c, [(r, ())]) for r, c in start.items()}
    # (cost of all runs of the state, order, runs and what they have become, steps)
    queue: list[tuple[float, int, dict[str, str], tuple[str, ...]]] = [(0.0, 0, {r: r for r in counts}, ())]
    seen, tick = {hash((r, r)) for r in counts}, 0
    while queue:
        _, _, state, path = heapq.heappop(queue)
        spent = STEP_COST * (len(path) + 1)
        evidence = "\n".join(s for r, s in state.items() for _ in range(min(counts[r], LEAST_OF_LETTERS)))
        # nothing behind the others can be cheaper
        state = {r: s for r, s in state.items() if spent + LOST * s.count("\ufffd") < best[r][0]}
        if not state:
            continue
        for name, out in _steps("\n".join(state.values()), evidence):
            changed, total = {}, 0.0
            for (r, s), new in zip(state.items(), out.split("\n")):
                if new == s:
                    continue
                reached = cost(new) + spent
                if reached < best[r][0]:
                    best[r] = (reached, [(new, (*path, name))])
                elif reached == best[r][0]:
                    best[r][1].append((new, (*path, name)))
                if (h := hash((r, new))) not in seen:
                    seen.add(h)
                    changed[r] = new
                    total += reached
            if changed:
                tick += 1
                heapq.heappush(queue, (total, tick, changed, (*path, name)))
    won: Counter[tuple[str, ...]] = Counter({(): 0})
    for r, (c, ways) in best.items():
        for new, path in ways:
            won[path] += (start[r] - c + len(VOWELS.findall(new))) * counts[r]
    order = lambda path: [ORDER[x] if x in ORDER else len(ORDER) + WRITTEN.index(x.split("/")[1]) if "/" in x else 99 for x in path]
    out = {r: (c, *min(ways, key=lambda w: (len(w[0]), -won[w[1]], len(w[1]), order(w[1])))) for r, (c, ways) in best.items()}
    # short runs may look right too early: the way of most of the text is followed where it leaves nothing worse
    common = min(won, key=lambda p: (-won[p], order(p)))
    for r, (c, _, path) in out.items():
        if len(path) < len(common) and (new := _follow(r, common)) is not None and cost(new) <= c - STEP_COST * len(path):
            out[r] = (cost(new) + STEP_COST * len(common), new, common)
    return out


def _follow(run: str, path: tuple[str, ...]) -> str | None:
    """What the steps of ``path`` make of a run; None where one of them changes nothing."""
    for name in path:
        if name in ORDER:
            taken = takes_back("\n".join([run] * LEAST_OF_LETTERS), name)
            new = SEQUENCE[name].sub(lambda m: taken.get(m[0], m[0]), run)  # noqa: B023
        else:
            new = dict(_steps(run, run)).get(name, run)
        if new == run:
            return None
        run = new
    return run


def repair(text: str | None) -> tuple[bool, str | None, str, float, int]:
    """Whether ``text`` is garbled, the cheapest text reached, the steps to it (those of different runs parted by
    commas), its cost, and how many characters were lost for good. Null texts and plain ASCII ones without escapes
    are never garbled."""
    if text is None or (text.isascii() and not any(x.search(text) for x in (REFERENCE, PERCENT, BACKSLASH))):
        return False, text, "", 0.0, 0
    found = _search(Counter(RUN.findall(text)))
    final = RUN.sub(lambda m: found[m[0]][1], text)
    paths = sorted({">".join(path) for _, _, path in found.values() if path})
    lost = final.count("\ufffd")
    garbled = bool(paths) or lost > 0 or bool(CONTROL.search(text))
    return garbled, final, ",".join(paths), float(sum(c for c, _, _ in found.values())), lost


def suspects() -> str:
    """A Java pattern that every garbled text matches: two neighbours that could be lead and further
    byte of a sequence, a control or lost character, an escape, four letters with marks or two East Asian signs in a row."""
    def esc(chars: Iterable[str]) -> str:
        """A class of the characters as ranges, which are much faster to test than single ones."""
        out, codes = [], sorted({ord(c) for c in chars})
        for k, c in enumerate(codes):
            if k and codes[k - 1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in out)

    tables = [t for c, t in TABLES.items() if c != "cp1256"]
    lead = esc(t[b] for t in tables for b in range(0xC2, 0xF5))
    more = esc(t[b] for t in TABLES.values() for b in range(0x80, 0xC0) if not "\u0600" <= t[b] < "\u0780")
    arabic = esc(t for b in range(0x80, 0xC0) if "\u0600" <= (t := TABLES["cp1256"][b]) < "\u0780")
    return rf"[{lead}][{more}]|[\x{{e0}}\x{{e2}}][{arabic}]|[\x{{637}}-\x{{63a}}][\x{{a0}}-\x{{bf}}\x{{201a}}-\x{{2122}}]|[\x{{80}}-\x{{84}}\x{{86}}-\x{{9f}}\x{{fffd}}]|&#?[A-Za-z0-9]{{2,31}};|[\x{{c0}}-\x{{ff}}\x{{152}}\x{{153}}\x{{160}}\x{{161}}\x{{178}}\x{{17d}}\x{{17e}}\x{{192}}\x{{aa}}\x{{b5}}\x{{ba}}]{{4}}|%[0-9A-Fa-f]{{2}}%[0-9A-Fa-f]{{2}}|\\\\[xu][0-9A-Fa-f]{{2}}|[\x{{3000}}-\x{{9fff}}\x{{ac00}}-\x{{d7a3}}\x{{f900}}-\x{{faff}}\x{{ff00}}-\x{{ffef}}]{{2}}"


#: characters of which every suspicious text has one: signs and letters other than ASCII, Arabic, Indic
RARE = r"[&%\\[^\x{0}-\x{7f}\x{600}-\x{6ff}\x{900}-\x{dff}\x{20b9}]]"


@F.pandas_udf(FIXED)
def repaired(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in texts:
        yield pd.DataFrame([repair(t) for t in series], columns=["garbled", "text", "steps", "cost", "lost"])


# marked so that Spark does not search once more for the filter on the outcome
repaired = repaired.asNondeterministic()


def restore(df: DataFrame, text: str | Column, *keys: str) -> DataFrame:
    """The garbled rows of ``df``: ``keys, garbled_text, restored_text, steps, lost``.

    Only rows with a suspicious neighbourhood, found inside the JVM, enter the search; null, empty
    and clean texts give no row, whatever their length; repeated rows come out repeated.
    """
    col = F.col(text) if isinstance(text, str) else text
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.select(*keys, col.alias("_t"))
        .where(F.col("_t").rlike(RARE) & F.col("_t").rlike(suspects()))
        # the few suspects cost much each, and garbled texts come together: deal them evenly
        .repartition(tasks)
        .withColumn("_r", repaired("_t"))
        .where("_r.garbled")
        .select(*keys, F.col("_t").alias("garbled_text"), F.col("_r.text").alias("restored_text"), F.col("_r.steps").alias("steps"), F.col("_r.lost").alias("lost"))
    )
