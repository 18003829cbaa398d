"""Sentence alignment in bilingual documents (problem 7).

Sentences of both sides are described by what survives translation: numbers, abbreviations in Latin
letters, names and other cognates by their consonants, and glossary terms. Sentence pairs that share
enough are anchors; the longest increasing chain of anchors keeps the order, the gaps between its
links are aligned by dynamic programming with one-to-one, one-to-many and empty steps, and anchors
off the chain that are strong by themselves are sentences that were moved. The rules are the same for texts of
every length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.llm.sentences import UNSEEN, WIDE, is_spaced, spans
from granthika.sources.tables import not_blank

MOST_TERMS = 100_000
PAIRS = "pkey bigint, en_start int, tr_start int, score double"

# ---- fixed values: consonants by class ----------------------------------------------------------
#: Devanagari consonants in code order, from ka to ha, by the class they fall into; the other Indic
#: blocks have theirs at the same offsets
INDIC = dict(zip("कखगघङचछजझञटठडढणतथदधनऩपफबभमयरऱलळऴवशषसह", "KKKKNCCJJNTTTTNTTTTNNPPPPNYRRLLLPSSSH"))
CLASSES: dict[int, str] = {}
for _c, _k in INDIC.items():
    for _o in range(0, 0x480, 0x80):
        CLASSES[ord(_c) + _o] = _k
for _o in range(0, 0x480, 0x80):
    CLASSES[0x902 + _o] = "N"
CLASSES[0x9AF] = CLASSES[0x9DF] = "Y"
CLASSES[0xA70] = "N"
for _cs, _k in (("بپف", "P"), ("تٹدڈطڑ", "T"), ("جزذضظژ", "J"), ("چ", "C"), ("سشصث", "S"), ("کقگخغك", "K"), ("ل", "L"), ("منں", "N"), ("ر", "R")):
    for _c in _cs:
        CLASSES[ord(_c)] = _k
DIGRAPHS = re.compile("gaon|rh|sh|ch|bh|dh|jh|kh|gh|th|ph|x")
DIGRAPH = {"gaon": "gav", "rh": "d", "sh": "s", "ch": "c", "bh": "b", "dh": "d", "jh": "j", "kh": "k", "gh": "g", "th": "t", "ph": "p", "x": "ks"}
LATIN = str.maketrans(dict(zip("bpfvwtdjzcskgqlmnryh", "PPPPPTTJJCSKKKLNNRYH")) | dict.fromkeys("aeiou"))
REPEATED = re.compile(r"([A-Z])\1+")
#: classes that the Arabic script also writes as vowels
WEAK = str.maketrans("", "", "YH")

NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
ACRONYM = re.compile(r"(?<![A-Za-z])(?:[A-Za-z]\.){2,}|(?<![A-Za-z.])[A-Za-z]{2,6}(?![A-Za-z])")
#: numbers, words in capitals, and names, by their first characters
FEATURE = re.compile(r"\d+(?:[.,]\d+)*|(?<![A-Za-z])[A-Z](?:[a-z]{3,}|(?<!\.[A-Z])[A-Z]{1,5})(?![A-Za-z])")
DOTTED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z]\.){2,}")
LATIN_LETTER = re.compile("[A-Za-z]")
ENGLISH = re.compile(r"[A-Za-z]+")
ARABIC = re.compile("[\u0600-\u077f]")


class _Classes(dict):
    """Letters to classes; white space and punctuation part words, everything else falls away."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = value = " " if c.isspace() or unicodedata.category(c)[0] in "PSZN" or c.isascii() else None
        return value


def _whole(word: str, text: str) -> bool:
    """Whether ``word``, which ``text`` contains, stands there as a whole word."""
    at = text.find(word)
    while at >= 0:
        before, after = text[at - 1 : at], text[at + len(word) : at + len(word) + 1]
        if not (before and unicodedata.category(before)[0] in "LM") and not (after and unicodedata.category(after)[0] in "LM"):
            return True
        at = text.find(word, at + 1)
    return False


LETTERS = _Classes(CLASSES | {0: "\0"})


def consonants(sentences: list[str]) -> list[str]:
    """Of each sentence in an Indic or Arabic script the consonant classes of its words, repeats taken
    once, with spaces around every word."""
    return [f" {x} " for x in REPEATED.sub(r"\1", "\0".join(sentences).translate(LETTERS)).split("\0")]


def latin_consonants(words: list[str]) -> list[str]:
    """The consonant classes of each of some words in Latin letters, repeats taken once."""
    low = DIGRAPHS.sub(_digraph, "\n".join(words).lower())
    return REPEATED.sub(r"\1", low.translate(LATIN)).split("\n")


def _digraph(m: re.Match) -> str:
    return DIGRAPH[m[0]]


def number(text: str) -> str:
    """A number in ASCII digits, without grouping; trailing zeros behind the point do not count."""
    s = (text if text.isascii() else "".join(c if c in ".," else str(unicodedata.decimal(c)) for c in text)).replace(",", "")
    return s.rstrip("0").rstrip(".") if "." in s else s


def near(a: str, b: str) -> bool:
    """Whether two strings are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def chain(anchors: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The chain of anchors with the most weight that increases on both sides: a longest increasing
    subsequence with weights, where neighbours may share one end (a sentence joined from several).

    Anchors are taken in order; a tree of prefix maxima over the second side has the best chain that
    ends at or before each place, so the cost is n log n.
    """
    anchors = sorted(anchors)
    size = max((j for _, j, _ in anchors), default=0) + 2
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    total, before = [0.0] * len(anchors), [-1] * len(anchors)
    for k, (_, j, w) in enumerate(anchors):
        best, x = (0.0, -1), j + 1
        while x > 0:
            best = max(best, tree[x])
            x &= x - 1
        total[k], before[k] = best[0] + w, best[1]
        x = j + 1
        while x <= size:
            if total[k] > tree[x][0]:
                tree[x] = (total[k], k)
            x += x & -x
    out, k = [], max(range(len(anchors)), key=total.__getitem__, default=-1)
    while k >= 0:
        out.append(anchors[k])
        k = before[k]
    return out[::-1]


class Side:
    """Sentences of one text and, for each feature, the sentences that have it."""

    def __init__(self, text: str, lang: str | None):
        self.spans = spans(text, lang)
        self.starts = [a for a, _ in self.spans]
        self.where: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.names: dict[str, set[int]] = defaultdict(set)
        self.lines: list[str] = []
        self.total = [0.0] * len(self.spans)
        self.by_length: dict[int, list[str]] | None = None

    def words(self) -> dict[str, set[int]]:
        """The words of ``lines``, of three and more consonants, and their sentences."""
        if not self.names:
            for i, line in enumerate(self.lines):
                for k in line.split():
                    if len(k) > 2:
                        self.names[k].add(i)
        return self.names

    def near(self, k: str) -> set[int]:
        """The sentences with a word at most one edit from ``k``, which cannot change both its ends."""
        if self.by_length is None:
            self.by_length = defaultdict(list)
            for w in self.words():
                if len(w) > 3:
                    self.by_length[len(w)].append(w)
        first, last, n = k[0], k[-1], len(k)
        return {j for size in (n - 1, n, n + 1) for w in self.by_length.get(size, ()) if (w[0] == first or w[-1] == last) and near(k, w) for j in self.names[w]}


def _english(text: str, terms: dict[str, list[str]], weak: bool) -> Side:
    s = Side(text, "en")
    names: list[tuple[int, bool, str]] = []
    for i, (a, b) in enumerate(s.spans):
        t = text[a:b]
        for x in FEATURE.findall(t):
            if x[0] < "A" or x[0] > "Z":
                s.where["n", number(x)].add(i)
            elif x[1] <= "Z":
                s.where["a", x].add(i)
            else:
                names.append((i, t.startswith(x), x))
        if terms:
            for w in terms.keys() & set(ENGLISH.findall(t.lower())):
                s.where["g", w].add(i)
        if "." in t[:-1]:
            for x in DOTTED.findall(t):
                s.where["a", x.replace(".", "").upper()].add(i)
    if names:
        for (i, first, _), k in zip(names, latin_consonants([x for _, _, x in names])):
            if weak:
                k = k.translate(WEAK)
            if len(k) > 3 or (len(k) == 3 and not first):
                s.names[k].add(i)
    return s


def _translated(text: str, lang: str | None, terms: dict[str, list[str]], wanted: set[str], acronyms: set[str], weak: bool) -> tuple[Side, bool]:
    s = Side(text, lang)
    spaced = is_spaced(text)
    words = {w: t for t in wanted for w in terms[t]}
    hidden, wide = UNSEEN.search(text) is not None, WIDE.search(text) is not None
    latin = bool(acronyms) and LATIN_LETTER.search(text) is not None
    if not hidden and not wide:
        words = {w: term for w, term in words.items() if w in text}
    seen: list[str] = []
    for i, (a, b) in enumerate(s.spans):
        t = text[a:b]
        if hidden:
            t = UNSEEN.sub("", t)
        if wide and WIDE.search(t):
            t = unicodedata.normalize("NFKC", t)
        for x in NUMBER.findall(t):
            s.where["n", number(x)].add(i)
        for x in ACRONYM.findall(t) if (latin or wide) and LATIN_LETTER.search(t) else ():
            x = x.replace(".", "").upper()
            if x in acronyms:
                s.where["a", x].add(i)
        seen.append(t)
        for w, term in words.items():
            if w in t and (not spaced or _whole(w, t)):
                s.where["g", term].add(i)
    s.lines = consonants(seen)
    if weak:
        s.lines = [x.translate(WEAK) for x in s.lines]
    if not spaced:
        s.lines = [REPEATED.sub(r"\1", x.replace(" ", "")) for x in s.lines]
    return s, spaced


WEIGHT = {"n": 2.5, "a": 3.0, "g": 1.0}


def _name_weight(k: str) -> float:
    return 1.0 if len(k) == 3 else 2.0 if len(k) == 4 else 3.0


def align(english: str | None, translated: str | None, terms: dict[str, list[str]], lang: str | None = None) -> list[tuple[int, int, float]]:
    """``(en_start, tr_start, score)`` of the sentence pairs; null or blank texts have none. ``lang`` is that of the translation."""
    if not english or not translated or not english.strip() or not translated.strip():
        return []
    weak = ARABIC.search(translated) is not None
    e = _english(english, terms, weak)
    wanted = {w for k, w in e.where if k == "g"}
    t, spaced = _translated(translated, lang, terms, wanted, {w for k, w in e.where if k == "a"}, weak)
    ne, nt = len(e.spans), len(t.spans)
    common: list[tuple[float, set[int], set[int]]] = []

    def shared(weight: float, es: set[int], ts: set[int]) -> None:
        common.append((weight / (min(len(es), FREQUENT) * min(len(ts), FREQUENT)) ** 0.5, es, ts))

    for key, es in e.where.items():
        w = WEIGHT[key[0]] if key[0] != "n" or len(key[1]) > 1 else 1.0
        part = w / min(len(es), FREQUENT)
        for i in es:
            e.total[i] += part
        if ts := t.where.get(key):
            shared(w, es, ts)
    for key, ts in t.where.items():
        w = WEIGHT[key[0]] if key[0] != "n" or len(key[1]) > 1 else 1.0
        part = w / min(len(ts), FREQUENT)
        for j in ts:
            t.total[j] += part
    for k, es in e.names.items():
        w = _name_weight(k)
        part = w / min(len(es), FREQUENT)
        for i in es:
            e.total[i] += part
        if not spaced:
            ts = {j for j, line in enumerate(t.lines) if k in line} if len(k) >= 4 else set()
        else:
            ts = t.words().get(k) or (t.near(k) if len(k) > 3 else set())
        if ts:
            part = w / min(len(ts), FREQUENT)
            for j in ts:
                t.total[j] += part
            shared(w, es, ts)

    score, evidence = _scores(common, nt)
    best_e: dict[int, float] = defaultdict(float)
    best_t: dict[int, float] = defaultdict(float)
    for (i, j), s in score.items():
        best_e[i], best_t[j] = max(best_e[i], s), max(best_t[j], s)

    def close(i: int, j: int) -> float:
        """How much of the sentence with less to share is shared."""
        return score[i, j] / max(LEAST, min(e.total[i], max(t.total[j], LEAST)))

    strong = []
    for (i, j), s in score.items():
        # enough in common, or nearly all of a sentence whose features are frequent
        if close(i, j) < 0.45 or not (s >= 3.0 or (evidence[i, j] >= 2 and s >= 0.8 * e.total[i] and s >= 0.95 * max(best_e[i], best_t[j]))):
            continue
        # one of the two has no better partner; a single common feature must be the best of both
        if evidence[i, j] < 2 and (s < best_e[i] or s < best_t[j]):
            continue
        if s >= 0.6 * best_e[i] or s >= 0.6 * best_t[j]:
            strong.append((i, j, s))
    path = chain(strong)
    pairs = {(i, j): s for i, j, s in path}
    rival_e: dict[int, float] = defaultdict(float)
    rival_t: dict[int, float] = defaultdict(float)

    def take(i: int, j: int, s: float) -> None:
        pairs[i, j] = s
        rival_e[i], rival_t[j] = max(rival_e[i], s), max(rival_t[j], s)

    for i, j, s in path:
        take(i, j, s)
    # anchors off the chain: moved sentences, if neither end has a better pair on the chain
    for i, j, s in sorted(strong, key=lambda x: (-x[2], x[:2])):
        if (i, j) in pairs:
            continue
        free = rival_e[i] == 0 and rival_t[j] == 0
        if (free or (s >= 5.0 and close(i, j) >= 0.55)) and (s >= 0.5 * rival_e[i] or s >= 0.5 * rival_t[j]):
            take(i, j, s)
    # the gaps between links of the chain
    bounds = [(-1, -1), *((i, j) for i, j, _ in path), (ne, nt)]
    rows: dict[int, list[int]] = defaultdict(list)
    for i, j in list(score):
        rows[i].append(j)
    for (i0, j0), (i1, j1) in zip(bounds, bounds[1:]):
        es = [i for i in range(i0 + 1, i1) if not rival_e[i]]
        ts = [j for j in range(j0 + 1, j1) if not rival_t[j]]
        if es and ts:
            for i, j in _gap(es, ts, rows, score, close):
                take(i, j, score[i, j])
    return sorted((e.starts[i], t.starts[j], s) for (i, j), s in pairs.items())


SKIP, LEAST = 0.3, 1.0
#: pairs of sentences that a feature proposes at which half of the weight that goes by their distance is at stake
HALF = 400
#: a feature loses no more weight once this many sentences have it
FREQUENT = 13
#: co-occurrences up to which they are added up one by one, else row by row, to the same sums
FEW = 20_000
#: no pair of a smaller score is ever taken
LOWEST = 0.45


def _scores(common: list[tuple[float, set[int], set[int]]], nt: int) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], int]]:
    """The summed weight and the number of common features of each sentence pair.

    Every co-occurrence counts. The weight falls with the distance between the ranks of the two occurrences: by
    nothing for a feature that stands once on each side, by up to a fifth the more pairs it proposes, which only
    parts pairs that are alike in all else. A row of pairs is held at a time where there are many, and of it only
    scores that may count.
    """
    score: dict[tuple[int, int], float] = defaultdict(float)
    evidence: dict[tuple[int, int], int] = defaultdict(int)
    if sum(len(es) * len(ts) for _, es, ts in common) <= FEW:
        for w, es, ts in common:
            m = len(es) * len(ts)
            if m == 1:
                (i,), (j,) = es, ts
                score[i, j] += w
                evidence[i, j] += 1
                continue
            stake, ys = 0.2 * (m - 1) / (m - 1 + HALF), sorted(ts)
            for x, i in enumerate(sorted(es)):
                y = x * len(ys) // len(es)
                for z, j in enumerate(ys):
                    score[i, j] += w * (1 - stake * abs(z - y) / (abs(z - y) + 1))
                    evidence[i, j] += 1
        return score, evidence
    of_row: dict[int, list[tuple[float, float, np.ndarray, int]]] = defaultdict(list)
    for w, es, ts in common:
        ys, m = np.array(sorted(ts)), len(es) * len(ts)
        for x, i in enumerate(sorted(es)):
            of_row[i].append((w, 0.2 * (m - 1) / (m - 1 + HALF), ys, x * len(ys) // len(es)))
    for i, features in of_row.items():
        total, n = np.zeros(nt), np.zeros(nt, np.int64)
        for w, stake, ys, y in features:
            d = np.abs(np.arange(len(ys)) - y)
            total[ys] += w * (1 - stake * d / (d + 1))
            n[ys] += 1
        for j in np.nonzero(total >= LOWEST)[0].tolist():
            score[i, j], evidence[i, j] = float(total[j]), int(n[j])
    return score, evidence


def _gap(es: list[int], ts: list[int], rows: dict[int, list[int]], score: dict[tuple[int, int], float], close) -> list[tuple[int, int]]:
    """Local dynamic programming over the sentences of a gap: pairs, two-to-one, one-to-two, or none.

    A step with a pair that loses is never better than the step without it, so only pairs with a gain, and
    two of them side by side, are steps; the best sequence of steps comes from prefix maxima over the
    second side, in n log n of the steps.
    """
    at = {j: y for y, j in enumerate(ts)}
    size = len(ts) + 1
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    steps: list[tuple[list[tuple[int, int]], int]] = []  # links, the step before
    waiting: list[tuple[int, float, int]] = []  # ends, totals and numbers of two-to-one steps into the next row
    best = (0.0, -1)

    def before(y: int) -> tuple[float, int]:
        """The best total of steps that end before ``y``."""
        found = (0.0, -1)
        while y > 0:
            found = max(found, tree[y], key=lambda t: t[0])
            y &= y - 1
        return found

    def gains(i: int) -> dict[int, float]:
        return {at[j]: g for j in rows.get(i, ()) if j in at and score[i, j] >= 1.0 and (g := close(i, j) - SKIP) > 0}

    def step(links: list[tuple[int, int]], value: float, y: int) -> tuple[int, float, int]:
        total, last = before(y)
        steps.append((links, last))
        return y + len({j for _, j in links}), total + value, len(steps) - 1

    following = gains(es[0])
    for x, i in enumerate(es):
        here, following = following, gains(es[x + 1]) if x + 1 < len(es) else {}
        ended, waiting = waiting, []
        for y, g in here.items():
            ended.append(step([(i, ts[y])], g, y))
            if y + 1 in here:
                ended.append(step([(i, ts[y]), (i, ts[y + 1])], g + here[y + 1], y))
            if y in following:
                waiting.append(step([(i, ts[y]), (es[x + 1], ts[y])], g + following[y], y))
        for end, total, k in ended:  # only now, so that no two steps share a row
            if total > best[0]:
                best = (total, k)
            while end <= size:
                if total > tree[end][0]:
                    tree[end] = (total, k)
                end += end & -end
    out, k = [], best[1]
    while k >= 0:
        out += steps[k][0]
        k = steps[k][1]
    return out


def _aligner(by_lang: dict[str, dict[str, list[str]]]):
    """Batches of ``pkey, lang, en, tr`` to batches of pairs, column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[str, list[str]] = defaultdict(list)
        for d in by_lang.values():
            for k, v in d.items():
                merged[k] += v
        for batch in batches:
            keys, found, counts = batch.column("pkey"), [], []
            for lang, en, tr in zip(*(batch.column(c).to_pylist() for c in ("lang", "en", "tr"))):
                pairs = align(en, tr, by_lang.get(lang) or merged, lang)
                found += pairs
                counts.append(len(pairs))
            if found:
                en_start, tr_start, score = zip(*found)
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([keys.take(rows), pa.array(en_start, pa.int32()), pa.array(tr_start, pa.int32()), pa.array(score, pa.float64())], names=["pkey", "en_start", "tr_start", "score"])

    return run


def glossary_terms(glossary: DataFrame, most: int = MOST_TERMS) -> dict[str, dict[str, list[str]]]:
    """The glossary by language, in the order of its terms. It goes to every task, so its size is checked: beyond ``most``
    rows (some 5 MB) this is an error."""
    rows = glossary.where("en_term is not null and tr_term is not null and lang is not null").select("lang", "en_term", "tr_term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the glossary has more than {most} terms")
    out: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for lang, en, tr in sorted(rows):
        out[lang][en.lower()].append(unicodedata.normalize("NFC", tr))
    return {k: dict(v) for k, v in out.items()}


def aligned(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """``pkey, en_start, tr_start, score``: sentence pairs of every position of ``passages``.

    Positions where either text is null or blank, or that only one list has, give no row; a null or unknown
    language uses the terms and short forms of all languages. ``pkey`` is ``row_id * 100 + position``.
    """
    p = F.col("passages")
    both = (
        rows.select("row_id", "lang", F.posexplode(F.arrays_zip(p["English_passages"].alias("e"), p["Translated_passages"].alias("t"))).alias("pos", "z"))
        .select((F.col("row_id") * 100 + F.col("pos")).alias("pkey"), "lang", F.col("z.e").alias("en"), F.col("z.t").alias("tr"))
        .where(not_blank(F.col("en")) & not_blank(F.col("tr")))
    )
    return both.select("pkey", "lang", "en", "tr").mapInArrow(_aligner(glossary_terms(glossary)), PAIRS)
