"""Filling containers of fixed capacity with whole items (problem 8).

Items are dealt by hash into groups of bounded size, each packed on its own by swap-based local
search. Bins that a group could not fill are opened again and packed together with those of other
groups, in groups that stay as small, for as many rounds as bins become fewer.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.llm.tokens import TOKENIZER, token_count
from granthika.session import cut

CAPACITY = 2048
PER_GROUP = 2000
FULL = 0.995


class _Bin:
    """Items of one bin by size; ``one`` its different sizes, ``two`` the sums of two of its items."""

    def __init__(self, items: dict[int, list[int]]):
        self.items = {s: i for s, i in items.items() if i}
        self.fill = sum(s * len(i) for s, i in self.items.items())
        self.one = np.array(sorted(self.items), np.int64)
        if len(self.one) > 1:
            a, b = np.triu_indices(len(self.one))
            double = np.array([len(self.items[s]) > 1 for s in self.one.tolist()])
            keep = (a != b) | double[a]
            a, b = self.one[a[keep]], self.one[b[keep]]
            order = np.argsort(a + b, kind="stable")
            self.parts, self.two = np.stack([a[order], b[order]], axis=1), (a + b)[order]
        else:
            s = self.one[:1] if len(self.one) and len(self.items[int(self.one[0])]) > 1 else self.one[:0]
            self.parts, self.two = np.stack([s, s], axis=1), 2 * s
        self.state = tuple((s, len(i)) for s, i in sorted(self.items.items()))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Each item, the largest first, into the fullest bin that still has room for it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(gaps, (sizes[i], -1))
        if k == len(gaps):
            bins.append([i])
            insort(gaps, (capacity - sizes[i], len(bins) - 1))
        else:
            room, b = gaps.pop(k)
            bins[b].append(i)
            insort(gaps, (room - sizes[i], b))
    return bins


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item positions, each of at most ``capacity``; every size must be at most that.

    Best fit decreasing first. Then a local search over all pairs of underfull bins: a move, an exchange
    of one for one, two for one or one for two is made if it raises the sum of squared fills, so that
    full bins get fuller and the emptiest run empty. It ends when no pair of bins has such a step, or as
    soon as there are no more bins than the items would need without any gap.
    """
    bins = best_fit_decreasing(sizes, capacity)
    least = -(-sum(sizes) // capacity)
    if len(bins) <= least:
        return bins
    search = _Search(sizes, bins, capacity, least)
    search.run()
    return [sorted(i for ids in b.items.values() for i in ids) for b in search.bins if b.fill]


class _Search:
    """The bins and, side by side, what all underfull ones could give: nothing, one item, two items."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int, least: int):
        self.capacity, self.least, self.alive = capacity, least, len(bins)
        self.bins: list[_Bin] = []
        for members in bins:
            items: dict[int, list[int]] = defaultdict(list)
            for i in members:
                items[sizes[i]].append(i)
            self.bins.append(_Bin(items))
        self.stale = True

    def _gather(self) -> None:
        under = [k for k, b in enumerate(self.bins) if 0 < b.fill < self.capacity]
        b = [self.bins[k] for k in under]
        self.ids = np.array(under, np.int64)
        self.fill = np.array([x.fill for x in b], np.int64)
        n = lambda field: np.repeat(np.arange(len(b)), [len(getattr(x, field)) for x in b])
        empty = np.zeros(0, np.int64)
        self.own1, self.one = n("one"), np.concatenate([x.one for x in b] or [empty])
        self.own2, self.two = n("two"), np.concatenate([x.two for x in b] or [empty])
        self.at2 = np.concatenate([np.arange(len(x.two)) for x in b] or [empty])
        self.stale = False

    def run(self) -> None:
        queue = [(b.fill, k) for k, b in enumerate(self.bins) if b.fill < self.capacity]
        heapq.heapify(queue)
        stuck: set[tuple] = set()
        while queue and self.alive > self.least:
            fill, k = heapq.heappop(queue)
            x = self.bins[k]
            if fill != x.fill or not 0 < x.fill < self.capacity or x.state in stuck:
                continue
            if self.stale:
                self._gather()
            step = self._best(k)
            if step is None:
                stuck.add(x.state)
                continue
            low, high, give, take = step
            a, b = {s: list(i) for s, i in self.bins[low].items.items()}, {s: list(i) for s, i in self.bins[high].items.items()}
            moved = [(s, a[s].pop()) for s in give], [(s, b[s].pop()) for s in take]
            for s, i in moved[0]:
                b.setdefault(s, []).append(i)
            for s, i in moved[1]:
                a.setdefault(s, []).append(i)
            self.bins[low], self.bins[high] = _Bin(a), _Bin(b)
            self.alive -= not self.bins[low].fill
            self.stale = True
            for z in (low, high):
                stuck.discard(self.bins[z].state)  # its partners are other ones now
                heapq.heappush(queue, (self.bins[z].fill, z))

    def _best(self, k: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """The step of bin ``k`` with any other that raises the squared fills most: who gives, who takes,
        and the sizes given and taken back."""
        x, best, found = self.bins[k], 0, None

        def consider(d: np.ndarray, giver: np.ndarray, taker: np.ndarray, ok: np.ndarray, make) -> None:
            """Steps by which ``d`` more passes over; (h + d)^2 + (l - d)^2 - h^2 - l^2 = 2d(d + h - l)."""
            nonlocal best, found
            if not len(d):
                return
            gain = np.where(ok & (d > 0) & (taker + d <= self.capacity), 2 * d * (d + taker - giver), 0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = int(gain[at]), make(at)

        nothing = np.zeros(1, np.int64)
        # (what the giver offers, what the taker gives back)
        shapes = ((1, 0), (1, 1), (2, 1), (1, 2))
        mine = {0: nothing, 1: x.one, 2: x.two}
        theirs = {0: (np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)), 1: (self.own1, self.one), 2: (self.own2, self.two)}
        sizes_of = lambda n, at: () if n == 0 else (int(x.one[at]),) if n == 1 else tuple(map(int, x.parts[at]))

        def other(n: int, at: int) -> tuple[int, ...]:
            if n == 0:
                return ()
            return (int(self.one[at]),) if n == 1 else tuple(map(int, self.bins[int(self.ids[self.own2[at]])].parts[self.at2[at]]))

        for give, take in shapes:
            # bin k gives: the largest of its offers that fits beside what each other one gives back
            own, back = theirs[take]
            if len(mine[give]):
                taker = self.fill[own]
                at = np.searchsorted(mine[give], self.capacity - taker + back, "right") - 1
                d = mine[give][np.maximum(at, 0)] - back
                consider(d, np.int64(x.fill), taker, (at >= 0) & (self.ids[own] != k), lambda p: (k, int(self.ids[own[p]]), sizes_of(give, at[p]), other(take, p)))  # noqa: B023
            # bin k takes: gives back the least with which each other one's offer fits
            own, offer = theirs[give]
            if len(mine[take]):
                at = np.searchsorted(mine[take], offer - (self.capacity - x.fill), "left")
                d = offer - mine[take][np.minimum(at, len(mine[take]) - 1)]
                consider(d, self.fill[own], np.int64(x.fill), (at < len(mine[take])) & (self.ids[own] != k), lambda p: (int(self.ids[own[p]]), k, other(give, p), sizes_of(take, at[p])))  # noqa: B023
        return found


def _packed(capacity: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "item_id", "piece_no"], ascending=[False, True, True]).reset_index(drop=True)
        sizes = items["n_tokens"].tolist()
        bin_of, fill = [0] * len(sizes), [0] * len(sizes)
        for b, members in enumerate(pack(sizes, capacity)):
            total = sum(sizes[i] for i in members)
            for i in members:
                bin_of[i], fill[i] = b, total
        items["bin"], items["fill"] = bin_of, fill
        return items[["item_id", "piece_no", "n_tokens", "grp", "bin", "fill"]]

    return run


PACKED = "item_id bigint, piece_no int, n_tokens int, grp bigint, bin int, fill int"


def pieces_of(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``item_id, piece_no, n_tokens``: whole items, and the pieces of those beyond ``capacity``.

    ``items`` has ``item_id, n_tokens``. Only an item larger than a container is split: into full
    containers and a rest. Items of null or no size take no space and are left out.
    """
    n = F.col("n_tokens")
    count = F.ceil(n / capacity).cast("int")
    return (
        items.where("item_id is not null and n_tokens > 0")
        .select(F.col("item_id").cast("bigint").alias("item_id"), n, F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"))
        .select("item_id", "piece_no", F.least(F.lit(capacity), n - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))
    )


def _round(left: DataFrame, deal, groups: int, capacity: int) -> DataFrame:
    """``left`` dealt into ``groups``, each packed on its own; the number of tasks is set, so that small
    groups are not brought together into one task."""
    tasks = min(groups, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 64))
    dealt = left.select("item_id", "piece_no", "n_tokens", deal.alias("grp")).repartition(tasks, "grp")
    return cut(dealt.groupBy("grp").applyInPandas(_packed(capacity), PACKED))


def _totals(packed: DataFrame) -> tuple[int, int, int]:
    """Number of items and of bins, and the least item's size."""
    bins = F.count_distinct("grp", "bin")
    n, b, least = packed.agg(F.count(F.lit(1)), bins, F.coalesce(F.min("n_tokens"), F.lit(0))).first()
    return n, b, least


def fill_containers(items: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP, full: float = FULL) -> DataFrame:
    """``container, item_id, piece_no, n_tokens, fill``: every item in one container of ``capacity``.

    ``items`` has ``item_id`` (unique) and ``n_tokens``; ties are broken by ``item_id``. No task ever
    holds more than about ``per_group`` items: items are dealt by hash into as many groups as that takes,
    in every round. Later rounds take only bins filled to less than ``full`` into which the least of the items
    that are left would fit or that hold more than one item (a bin of one item and no room for another stays as it
    is), dealt anew by bin; they end when a round saved less than one bin in a hundred, or when all
    that is left was packed as one group. An empty table has no container.
    """
    left = cut(pieces_of(items, capacity))
    again = left.count()
    groups = max(1, -(-again // per_group))
    packed = _round(left, F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(groups)), groups, capacity)
    cols = ["container", "item_id", "piece_no", "n_tokens", "fill"]
    done, level, before = [], 0, None
    while True:
        named = packed.withColumn("container", F.lit(level << 56) + F.col("grp") * (1 << 20) + F.col("bin"))
        under = packed.where(F.col("fill") < full * capacity)
        again, bins, least = _totals(under)
        closed = (F.col("fill") >= full * capacity) | ((F.col("fill") == F.col("n_tokens")) & (F.col("fill") + least > capacity))
        again, bins, _ = _totals(packed.where(~closed))
        if groups == 1 or bins < 2 or (before is not None and before - bins < before / 100 and level > 1):
            done.append(named.select(*cols))
            break
        done.append(named.where(closed).select(*cols))
        level, before = level + 1, bins
        groups = max(1, -(-again // per_group))
        packed = _round(packed.where(~closed), F.pmod(F.xxhash64(F.lit(level), "grp", "bin"), F.lit(groups)), groups, capacity)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def documents_in_containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``fill_containers`` over the texts of ``documents`` (``doc_id, text``), sized in tokens."""
    sized = documents.where("text is not null and text <> ''").select(F.col("doc_id").alias("item_id"), token_count(tokenizer)("text").alias("n_tokens"))
    return fill_containers(sized, capacity).withColumnRenamed("item_id", "doc_id")
