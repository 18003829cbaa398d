"""Near-duplicate texts (problem 2): SuperMinHash signatures, banding, verification, union-find.

Texts with the same set of word runs are one class. Classes get a SuperMinHash signature: every
element ranks all positions of the signature by a random permutation of its own, so that the values
of one element are correlated and differ between positions, and the estimate varies less than with
independent hashes. Elements are taken one rank at a time and stop as soon as their rank can lower no
position any more. Classes that agree on a band of their signatures are candidates and are verified
on their whole sets; groups are the connected components of the verified links. Bands that very many
classes share are not paired: their classes are compared by their rarest runs instead, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from granthika.llm.lines import words_of
from granthika.operators.skew import skew_join
from granthika.session import cut

#: classes of one band up to which they are paired with each other
CROWD = 100


def word_runs(text: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``width`` consecutive words.

    A text of fewer words has one run of them all; a text without any word has none.
    """
    words = words_of(text)

    def runs(w: Column) -> Column:
        n = F.greatest(F.size(w) - width + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, width)))

    one = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))
    return one[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``width`` words of many texts, given their words' hashes one text after another
    and how many each has (at least one): the runs' hashes and where each text's begin."""
    n = np.maximum(counts - width + 1, 1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner]
    end = (starts + counts)[owner]
    run = np.zeros(len(owner), np.uint64)
    for k in range(width):
        at = first + k
        run = _mix(run * np.uint64(0x100000001B3) ^ np.where(at < end, words[np.minimum(at, len(words) - 1)], np.uint64(0)))
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])])
    return run[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(counts)))])


#: elements whose permutations are held at a time
ELEMENTS = 1 << 16


def superminhash(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures, a row per set.

    ``values`` holds the 64-bit elements of all sets one after another, ``offsets`` where each set
    begins and the last one ends. Rank by rank, every element still running draws its place in the
    signature (a step of a Fisher-Yates shuffle seeded by the element) and a value between its rank
    and the next; a position keeps the least. An element stops once its rank exceeds the largest
    value in its set's signature. A signature is the least of those of its parts, so elements are taken a bounded
    number at a time, however large a set is. An empty set has a signature of infinities.
    """
    sets = len(offsets) - 1
    sizes = np.diff(offsets)
    owners = np.repeat(np.arange(sizes.size), sizes)
    sig = np.full(sets * size, np.inf)
    for begin in range(0, len(values), ELEMENTS):
        state, owner = values[begin : begin + ELEMENTS].astype(np.uint64), owners[begin : begin + ELEMENTS]
        low, high = int(owner[0]), int(owner[-1]) + 1
        perm = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(state), 1))
        live = np.arange(len(state))
        for rank in range(size):
            if not live.size:
                break
            r = _mix(state[live] + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & 0xFFFFFFFFFFFFFFFF))
            pick = rank + ((r >> np.uint64(40)) % np.uint64(size - rank)).astype(np.intp)
            chosen = perm[live, pick]
            perm[live, pick] = perm[live, rank]
            value = rank + (r & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
            np.minimum.at(sig, owner[live] * size + chosen, value)
            top = sig[low * size : high * size].reshape(high - low, size).max(axis=1)
            live = live[top[owner[live] - low] > rank + 1]
    return sig.reshape(sets, size)


#: scope of texts that are compared with the whole of their table
WIDE = -1
SIGNED = StructType([StructField("tbl", StringType()), StructField("scope", LongType()), StructField("key", LongType()), StructField("bare", LongType()), StructField("cls", LongType()), StructField("n", IntegerType()), StructField("bands", ArrayType(LongType())), StructField("s1", LongType()), StructField("s2", LongType())])


def shape_for(similarity: float, wide: bool) -> tuple[int, int]:
    """Bands and rows: a pair right at ``similarity`` is missed once in 200 times, above it ever less.

    Within a small scope short bands do; over a whole table they would bring up every pair of texts
    that share some phrases, so bands are longer there and there are more of them.
    """
    rows = (4 if similarity < 0.7 else 8) if wide else 2
    return int(np.ceil(np.log(0.005) / np.log(1 - similarity**rows))), rows


SKETCH = 128


def most_differing(similarity: float) -> int:
    """Sketch bits in which two sets may differ that reach ``similarity``: four deviations above the mean."""
    q = (1 - similarity) / 2
    return int(np.ceil(SKETCH * q + 4 * np.sqrt(SKETCH * q * (1 - q))))


def band_keys(values: np.ndarray, offsets: np.ndarray, scopes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray | None]:
    """64-bit keys of every set's bands (sets x bands; band number and scope are mixed in), and a sketch
    of 128 bits, one of each signature position, where the signature is that long."""
    keys = np.empty((len(offsets) - 1, bands), np.uint64)
    sketch = np.empty((len(keys), 2), np.uint64) if bands * rows >= SKETCH else None
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i = 0
    while i < len(keys):  # blocks of bounded size, so that the permutations fit in memory
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + ELEMENTS, "right")) - 1)
        h = superminhash(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bands * rows).view(np.uint64).reshape(j - i, bands, rows)
        key = np.broadcast_to(_mix(scopes[i:j, None] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (j - i, bands)).copy()
        for r in range(rows):
            key = _mix(key * np.uint64(0x100000001B3) ^ h[:, :, r])
        keys[i:j] = key
        if sketch is not None:
            bits = _mix(h.reshape(j - i, -1)[:, :SKETCH]) & np.uint64(1)
            sketch[i:j] = (bits.reshape(j - i, 2, 64) * place).sum(axis=2, dtype=np.uint64)
        i = j
    return keys, sketch


def signed(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``tbl, scope, key, bare, cls, n, bands, s1, s2`` of every text with a word, in one pass.

    ``bare`` is a 64-bit hash of the bare text, ``cls`` one of the scope and the set of runs, the same for equal sets, ``n``
    their number. Texts are cut into words and hashed inside the JVM, once, runs and signatures made from whole Arrow batches of them.
    """
    shapes = {wide: shape_for(similarity, wide) for wide in (True, False)}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wide, (bands, rows) in shapes.items():
                b = batch.filter(pc.and_(pc.equal(pc.equal(batch.column("scope"), WIDE), wide), pc.greater(pc.list_value_length(batch.column("words")), 0)))
                if not b.num_rows:
                    continue
                words = b.column("words")
                counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                values, offsets = runs_of(words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), counts, width)
                n = np.diff(offsets)
                scopes = _mix(b.column("scope").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                cls = _mix(np.add.reduceat(_mix(values), offsets[:-1]) ^ scopes ^ n.astype(np.uint64))
                keys, sketch = band_keys(values, offsets, scopes, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [b.column("tbl"), b.column("scope"), b.column("key"), b.column("bare"), pa.array(cls.view(np.int64)), pa.array(n.astype(np.int32)), lists]
                columns += [pa.nulls(len(n), pa.int64()) if sketch is None else pa.array(sketch[:, k].copy().view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=SIGNED.fieldNames())

    hashed = F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(F.xxhash64(F.array_join(w, "")).alias("bare"), F.transform(w, lambda x: F.xxhash64(x)).alias("words")))[0]
    return texts.select("tbl", "scope", "key", hashed.alias("h")).select("tbl", "scope", "key", "h.bare", "h.words").mapInArrow(sign, SIGNED)


def _runs_of_classes(asked: DataFrame, members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``cls, scope, runs`` for the asked classes, made again from one text of each."""
    which = members.join(asked, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("tbl", "key")).alias("m")).select("cls", "m.tbl", "m.key")
    return texts.select("tbl", "scope", "key", "text").join(which, ["tbl", "key"]).dropDuplicates(["cls"]).select("cls", "scope", word_runs(F.col("text"), width).alias("runs"))


def by_rarest_runs(sets: DataFrame, similarity: float) -> DataFrame:
    """``cls_a, cls_b``: every pair of ``sets`` (``cls, scope, runs``) of one scope that may reach ``similarity``, without loss.

    Sets of that similarity share one of the first ``n - ceil(similarity * n) + 1`` of their runs, the rarest first, at
    places that leave enough runs behind them. What all texts of a kind have in common comes last and
    brings no pair up.
    """
    sets = cut(sets.select("cls", F.transform("runs", lambda x: F.xxhash64(x, F.col("scope"))).alias("runs")))
    each = sets.select("cls", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    often = cut(each.groupBy("run").agg(F.count(F.lit(1)).alias("n")))
    ranked = skew_join(each, often.select("run", F.col("n").alias("df")), ["run"], F.col("cls"), often).groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "run"))).alias("r"))
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    prefix = cut(ranked.select("cls", "n", F.posexplode(F.slice("r", F.lit(1), length)).alias("at", "x")).where("x.df > 1").select("cls", "n", "at", "x.run"))
    side = lambda s: prefix.select("run", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "at")])
    counts = prefix.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    # at the first run in common no more than what is behind it can be shared; later ones may bring a pair up again
    return skew_join(side("a"), side("b"), ["run"], F.col("cls_a"), counts).where((F.col("cls_a") < F.col("cls_b")) & (left >= needed)).select("cls_a", "cls_b").distinct()


def similar_classes(members: DataFrame, texts: DataFrame, width: int, similarity: float, crowd: int = CROWD) -> DataFrame:
    """Pairs of classes whose sets of runs reach ``similarity``: ``cls_a, cls_b, jaccard``, cls_a < cls_b.

    Candidates share a band and have sets of sizes that allow the similarity. A band of more than ``crowd``
    classes is not paired in itself: all its classes are compared by their rarest runs. Each
    candidate is verified on the whole sets, which are made again for candidate classes only.
    """
    band = members.groupBy("cls").agg(F.first("bands").alias("bands")).select("cls", F.explode("bands").alias("band"))
    shared = cut(band.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("n > 1"))
    found = shared.where("n = 2").select(F.col("low").alias("cls_a"), F.col("high").alias("cls_b"))
    some = band.join(shared.where(f"n > 2 and n <= {crowd}").select("band"), "band")
    a, b = (some.select("band", F.col("cls").alias(f"cls_{s}")) for s in "ab")
    found = found.unionByName(a.join(b, "band").where("cls_a < cls_b").select("cls_a", "cls_b"))
    crowded = shared.where(F.col("n") > crowd).select("band", "n")
    if not crowded.isEmpty():
        within = skew_join(band, crowded.select("band"), ["band"], F.col("cls"), crowded, "left_semi").select("cls").distinct()
        found = found.unionByName(by_rarest_runs(_runs_of_classes(within, members, texts, width), similarity))
    # before whole sets are fetched: their sizes, and a glance at the sketches, which drops most pairs far below
    sketch = lambda s: members.groupBy("cls").agg(*[F.first(c).alias(f"{c}_{s}") for c in ("n", "s1", "s2")]).withColumnRenamed("cls", f"cls_{s}")
    differing = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    near = found.distinct().join(sketch("a"), "cls_a").join(sketch("b"), "cls_b").where(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-9)
    candidates = cut(near.where(F.coalesce(differing <= most_differing(similarity), F.lit(True))).select("cls_a", "cls_b"))
    asked = candidates.select(F.col("cls_a").alias("cls")).unionByName(candidates.select(F.col("cls_b").alias("cls"))).distinct()
    sets = _runs_of_classes(asked, members, texts, width)
    with_a = skew_join(candidates, sets.select(F.col("cls").alias("cls_a"), F.col("runs").alias("r_a")), ["cls_a"], F.col("cls_b"))
    with_b = with_a.join(sets.select(F.col("cls").alias("cls_b"), F.col("runs").alias("r_b")), "cls_b")
    return (
        with_b.withColumn("_c", F.size(F.array_intersect("r_a", "r_b")))
        .withColumn("jaccard", F.col("_c") / (F.size("r_a") + F.size("r_b") - F.col("_c")))
        .where(F.col("jaccard") >= similarity)
        .select("cls_a", "cls_b", "jaccard")
    )


def near_pairs(texts: DataFrame, width: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """Every pair of near-duplicate texts that are not equal when bare: ``tbl, key_a, key_b``.

    ``texts`` has ``tbl, scope, key, text`` (``scope`` -1: compared with the whole table, else only
    with texts of the same scope). Links are found between
    classes and then written out for their members; different texts of one class are linked too.
    Texts without a word, null ones among them, have no partner; of a row repeated as a whole the
    copies are equal when bare and so no pair.
    """
    members = cut(signed(texts, width, similarity))
    links = similar_classes(members, texts, width, similarity, crowd).select("cls_a", "cls_b")
    # links between forms (a class and a bare text): copies of one form are never paired with each other
    forms = members.select("tbl", "cls", "bare").distinct()
    f = lambda s: forms.select("tbl", F.col("cls").alias(f"cls_{s}"), F.col("bare").alias(f"bare_{s}"))
    across = links.join(f("a"), "cls_a").join(f("b"), ["cls_b", "tbl"]).where("bare_a <> bare_b")
    several = forms.groupBy("tbl", "cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tbl", F.col("cls").alias("cls_a"))
    inside = several.join(f("a"), ["tbl", "cls_a"]).join(f("b").withColumn("cls_a", F.col("cls_b")), ["tbl", "cls_a"]).where("bare_a < bare_b")
    cols = ["tbl", "cls_a", "bare_a", "cls_b", "bare_b"]
    pairs = across.select(*cols).unionByName(inside.select(*cols))
    copies = members.groupBy("tbl", "cls", "bare").agg(F.count(F.lit(1)).alias("n"))
    # the copies of a form are dealt over salts; a pair of forms meets each part of them
    for s in "ab":
        rows = members.select("tbl", F.col("cls").alias(f"cls_{s}"), F.col("bare").alias(f"bare_{s}"), F.col("key").alias(f"k_{s}"))
        pairs = skew_join(rows, pairs, ["tbl", f"cls_{s}", f"bare_{s}"], F.col(f"k_{s}"), copies.withColumnsRenamed({"cls": f"cls_{s}", "bare": f"bare_{s}"}))
    return pairs.select("tbl", F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b"))


def _forest(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges, by union-find: fewer edges, the same components."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while (p := parent.get(x, x)) != root:
                parent[x], x = root, p
            return root

        kept: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            if len(parent) > 1_000_000:  # bounded memory: begin a new forest
                yield out()
                parent, kept = {}, []
        yield out()

    return edges.select("a", "b").mapInArrow(unite, "a bigint, b bigint")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` integers): ``node, root``, root the least member.

    Union-find within partitions first; then large-star and small-star rounds, which each halve the
    depth, until nothing changes. Every round is written to the checkpoint folder. Nothing but the
    count of changed rows reaches the driver.
    """
    e = cut(_forest(edges.where("a <> b")).where("a <> b"))
    for _ in range(most_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: the neighbours above u join the least of its neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and the neighbours below it join the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small)
        same = new.count() == e.count() and new.join(e.select("a", "b"), ["a", "b"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_groups(texts: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per text: ``tbl, key, group_key, links``.

    ``group_key`` is the least key of the text's group of near-duplicates, its own if it has none;
    ``links`` counts the other classes that its class is linked to. Texts without words are alone.
    """
    members = cut(signed(texts, width, similarity))
    links = cut(similar_classes(members, texts, width, similarity).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    roots = components(links)
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    linked = roots.withColumnRenamed("node", "cls").join(degree, "cls")
    alone = members.join(linked, "cls", "left_anti").select("tbl", "key", F.col("cls").alias("root"), F.lit(0).cast("long").alias("links"))
    per = cut(skew_join(members.select("tbl", "key", "cls"), linked, ["cls"], F.col("key")).select("tbl", "key", "root", "links").unionByName(alone))
    # the least key of each group: aggregated first, so that a large group meets its label cheaply
    label = per.groupBy("tbl", "root").agg(F.min("key").alias("group_key"))
    rest = texts.select("tbl", "key").join(members.select("tbl", "key"), ["tbl", "key"], "left_anti")
    return skew_join(per, label, ["tbl", "root"], F.col("key")).select("tbl", "key", "group_key", "links").unionByName(rest.select("tbl", "key", F.col("key").alias("group_key"), F.lit(0).cast("long").alias("links")))
