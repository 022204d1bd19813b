"""Near-duplicates by ProbMinHash: signatures, banding, verification, classes.

A document is its five-word shingles weighted by their counts. Each shingle sends
out arrivals of a Poisson process whose rate is its weight; each arrival falls on
one of K components, which keep their earliest. Processes end as soon as they are
later than every component's earliest (Ertl, TKDE 2020). Two signatures agree in a
component with the probability Jaccard similarity of the weighted shingles. With
all weights equal that is the Jaccard similarity of the sets, so a text of uneven
counts has a second signature, without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_checkpoint_dir, keyed_text, parts_by_size

WORDS = 5
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Texts of fewer different shingles than this agree at 0.8 only where their sets are equal (weights aside).
FEW = 4
#: Buckets of up to so many texts yield all their pairs, larger ones those with their hubs.
SMALL_BUCKET = 8
HUBS = 3
#: Links between classes so far, up to so many of which one task joins at once (16 MB).
LINKS_AT_ONCE = 1 << 20
#: Bits by hash of the ids whose texts are wanted.
MOST_BITS = 1 << 24
#: Counters of shingles by hash: an order of all shingles, rare ones first, needs no more than this on the driver.
CELLS = 1 << 16

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted; a text of one to four words is one shingle."""
    owners, parts = [], []
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        n = max(1, len(h) - WORDS + 1)
        s = np.full(n, np.uint64(min(len(h), WORDS)), np.uint64)
        for j in range(min(WORDS, len(h))):
            s = mixed(s * _GOLD + h[j : j + n])
        parts.append(s)
        owners.append(np.full(n, k))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, shingle = np.concatenate(owners), np.concatenate(parts)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])]))
    return owner[first], shingle[first], np.diff(np.append(first, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[n, K] of 32-bit values: the shingle whose arrival was first in each component."""
    best = np.full(n * K, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    low = mixed(shingle) & np.uint64(0xFFFFFFFF)
    time, live, turn = np.zeros(len(owner)), np.arange(len(owner)), 0
    while len(live):
        # Several arrivals at once when few processes are left.
        many = int(np.clip(20_000 // len(live), 1, 64))
        draws = mixed(shingle[live][:, None] + (np.arange(turn, turn + many, dtype=np.uint64) + np.uint64(1)) * _GOLD)
        gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        times = time[live][:, None] + np.cumsum(gaps, 1) / weight[live][:, None]
        cell = (mixed(draws + _GOLD) % np.uint64(K)).astype(np.int64) + (owner[live] * K)[:, None]
        value = (times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low[live][:, None]
        np.minimum.at(best, cell.ravel(), value.ravel())
        time[live] = times[:, -1]
        turn += many
        latest = (best.reshape(n, K).max(1) >> np.uint64(32)).astype(np.uint32)
        limit = np.where(latest == 0xFFFFFFFF, np.inf, latest.view(np.float32))
        live = live[time[live] <= limit[owner[live]]]
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, K)


def band_hashes(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> list[np.ndarray]:
    """A hash for each band of each text's signatures; one hash of the set for texts of few shingles; none for no words.

    Bands of the set's signature are hashed as those of counts are. Where all counts
    are one number the two signatures are the same, and such a text has one.
    """
    size = np.bincount(owner, minlength=n)
    low, high = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    np.minimum.at(low, owner, weight), np.maximum.at(high, owner, weight)
    uneven = low < high
    of = uneven[owner]
    # Texts n and up are those of uneven counts once more, with all weights 1.
    again = n + np.cumsum(uneven)[owner[of]] - 1
    owners, shingles = np.concatenate([owner, again]), np.concatenate([shingle, shingle[of]])
    m = n + int(uneven.sum())
    sig = signatures(owners, shingles, np.concatenate([np.where(of, weight, 1), np.ones(len(again))]).astype(float), m).astype(np.uint64).reshape(m, BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (m, 1))
    for j in range(ROWS):
        h = mixed(h * _GOLD + sig[:, :, j])
    h = h.view(np.int64)
    both = dict(zip(np.flatnonzero(uneven).tolist(), h[n:], strict=True))
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, owner, mixed(shingle))
    exact = mixed(sums).view(np.int64)
    bands = [np.union1d(h[k], both[k]) if k in both else h[k] for k in range(n)]
    return [np.append(bands[k], exact[k]) if 0 < size[k] < FEW else bands[k] if size[k] else h[k][:0] for k in range(n)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard of the counts and Jaccard of the sets; each is (sorted shingles, counts)."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    plain = len(i) / (len(x) + len(y) - len(i))
    if not len(i):
        return 0.0
    # sum over common d of 1 / sum over e of max(v_e / v_d, w_e / w_d), by the order of the ratios v / w
    p, q = v[i] / v.sum(), w[j] / w.sum()
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    only_p, only_q = 1 - p.sum(), 1 - q.sum()
    # below[d]: elements of ratio at most d's, whose larger term is w_e / w_d
    below_q, above_p = np.cumsum(q), p.sum() - np.cumsum(p)
    total = (below_q + max(only_q, 0)) / q + (above_p + max(only_p, 0)) / p
    return max(plain, float((1 / total).sum()))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, bands) of every text: text_key is equal for equal texts."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts_by_size(batch):
                owner, shingle, count = weighted_shingles(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "bands": band_hashes(owner, shingle, count, len(part))})

    return docs.select("doc_id", text_key("text").alias("text_key"), "text").mapInPandas(rows, "doc_id long, text_key binary, bands array<long>")


def text_key(text: str) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def weighted_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles, counts): sorted shingles of a text and their counts as packed bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts_by_size(batch):
                owner, shingle, count = weighted_shingles(part["text"].tolist())
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                packed = [(shingle[a:b].tobytes(), count[a:b].astype(np.uint16 if count[a:b].max(initial=0) < 65536 else np.uint64).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pd.DataFrame({"node": part["node"], "shingles": [p[0] for p in packed], "counts": [p[1] for p in packed]})

    return docs.select("node", "text").mapInPandas(rows, "node long, shingles binary, counts binary")


def unpacked(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(shingles, np.uint64)
    return x, np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(x) else np.uint64).astype(float)


def links_of(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are near."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"), F.col("counts").alias(f"c{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "ca", "sb", "cb")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            near = [similarity(unpacked(sa, ca), unpacked(sb, cb)) >= least - 1e-12 for sa, ca, sb, cb in zip(x["sa"], x["ca"], x["sb"], x["cb"], strict=True)]
            yield x.loc[near, ["a", "b"]]

    return both.mapInPandas(rows, "a long, b long")


def shared_buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, n, hubs) of the buckets that several nodes are in: n nodes, of whom hubs are the least of each of HUBS parts by hash."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))  # a hash has its band in it
    hub = lambda k: F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(HUBS)) == k, F.col("node")))
    # Written out, so that the join with a very large bucket is one that Spark can split by size, or broadcast where it is small.
    crowded = scratch.store(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.array_compact(F.array(*[hub(k) for k in range(HUBS)])).alias("hubs")).where("n > 1"))
    out = scratch.store(rows.join(crowded, "bucket").select("bucket", "node", "n", "hubs"))
    scratch.drop(crowded)
    return out


def candidates(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, from (bucket, node, n, hubs).

    Buckets of up to SMALL_BUCKET nodes yield all their pairs. In a larger one each
    node is held against the bucket's hubs, which joins most of it at the cost of its
    size; links_apart finds the links that this leaves.
    """
    few = buckets.where(F.col("n") <= SMALL_BUCKET).select("bucket", "node")
    asked = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "bucket").where("a < b").select("a", "b")
    many = buckets.where(F.col("n") > SMALL_BUCKET).select("node", F.explode("hubs").alias("hub")).where("node != hub")
    return asked.unionByName(many.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each of CELLS cells by hash."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for packed in batch["shingles"]:
                n += np.bincount((np.frombuffer(packed, np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(n)
        yield pd.DataFrame({"cell": cell, "n": n[cell]})

    out = np.zeros(CELLS, np.int64)
    for cell, n in sets.select("shingles").mapInPandas(rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    return out


def prefixes(sets: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """(shingle, node, class, p, rest, n, even): the first shingles of each set in one order of all shingles, rare cells first.

    Of a set of n shingles, rest are from this one on, and 1 / p of its counts; even:
    all counts are one number. Shingles are left out once both shares are below
    `least`: two sets with no shingle in common up to there have less than that in common.
    """

    def first(node: int, group: int, packed: bytes, counts: bytes) -> pd.DataFrame:
        x, w = unpacked(packed, counts)
        order = np.lexsort((x, common[(x % np.uint64(CELLS)).astype(np.int64)]))
        w = w[order]
        p = np.cumsum(w[::-1])[::-1] / w.sum()
        rest = np.arange(len(x), 0, -1)
        n = np.count_nonzero(np.maximum(p, rest / len(x)) >= least - 1e-9)
        return pd.DataFrame({"shingle": x[order[:n]].view(np.int64), "node": node, "class": group, "p": 1 / p[:n], "rest": rest[:n], "n": len(x), "even": bool((w == w[0]).all())})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets_of = list(zip(batch["node"], batch["class"], batch["shingles"], batch["counts"], strict=True))
            for k in range(0, len(sets_of), 50):
                yield pd.concat([first(*x) for x in sets_of[k : k + 50]])

    return sets.select("node", "class", "shingles", "counts").mapInPandas(rows, "shingle long, node long, class long, p double, rest long, n long, even boolean")


def links_apart(buckets: DataFrame, label: DataFrame, sets: DataFrame, least: float, scratch: Scratch | None = None) -> DataFrame:
    """All links (a, b) between classes of label that meet in a bucket of more than SMALL_BUCKET nodes.

    Whatever meets in a bucket and is of one class already needs no look. The rest is
    an exact prefix-filter join. From the first common shingle of two sets on, no more
    can be common than the smaller rest has, which bounds Jaccard, and so probability
    Jaccard where counts are even. With shares P and Q of uneven counts from there on,
    probability Jaccard is at most 1 / (1/P + 1/Q - 1), since the sum over common
    shingles of 1 / (1/p + (1 - Q)/q) is greatest where p and q are in proportion.
    Within a shingle, the class with most sets is not held against itself, so a group
    of thousands that is one class costs its size.
    """
    scratch = scratch or Scratch(sets.sparkSession)
    of = scratch.store(buckets.select("bucket", "node").join(label, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class")))
    split = of.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).where(f"n > {SMALL_BUCKET} and lo < hi")
    nodes = of.join(split.select("bucket"), "bucket").select("node", "class").distinct()
    parts = scratch.store(sets.join(nodes, "node"))
    scratch.drop(of)
    if parts.isEmpty():
        return sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    first = scratch.store(prefixes(parts, cell_counts(parts), least))
    scratch.drop(parts)
    most = first.groupBy("shingle", "class").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("k"))
    shared = scratch.store(first.join(most.where("k > 1").select("shingle", "main"), "shingle"))
    scratch.drop(first)
    left = shared.where("class != main").select("shingle", F.col("node").alias("x"), F.col("class").alias("xc"), F.col("p").alias("xp"), F.col("rest").alias("xrest"), F.col("n").alias("xn"), F.col("even").alias("xeven"))
    overlap = F.least("xrest", "rest") * (1 + least) >= least * (F.col("xn") + F.col("n")) - 1e-6
    uneven = ~(F.col("xeven") & F.col("even")) & (F.col("xp") + F.col("p") <= 1 + 1 / least + 1e-9)
    may = (F.col("xc") != F.col("class")) & ((F.col("class") == F.col("main")) | (F.col("xc") < F.col("class"))) & (overlap | uneven)
    pairs = left.join(shared, "shingle").where(may).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    return links_of(pairs, sets, least)


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that links lead to) of the nodes of links (a, b): labels of labels until links agree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (apart := label[x] != label[y]).any():
        x, y = x[apart], y[apart]
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least), np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class): class is one of the nodes that links lead to, the same for all of them; by contraction.

    In a round each node takes the first of itself and its neighbours in one order
    for its label, and links are put between labels; those within one label go. Once
    at most LINKS_AT_ONCE are left, one task joins them. The first order is by number,
    as hubs are least; the later ones are by hash, so that a chain shrinks by a part in
    every round whatever its numbers. A node with very many links is combined before
    the shuffle.
    """

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(batches):
            whole = pd.concat(parts)
            nodes, least = joined(whole["a"].to_numpy(np.int64), whole["b"].to_numpy(np.int64))
            yield pd.DataFrame({"node": nodes, "class": least})

    rounds: list[DataFrame] = []
    while links.count() > LINKS_AT_ONCE:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("v")))
        if rounds:
            place = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c), F.col(c).alias("v"))
            first = F.least(F.min(place("v")), F.first(place("node")))["v"]
        else:
            first = F.least(F.min("v"), F.first("node"))
        label = scratch.store(both.groupBy("node").agg(first.alias("class")))
        rounds.append(label)
        side = lambda c, to: label.select(F.col("node").alias(c), F.col("class").alias(to))  # noqa: B023, E731
        apart = links.join(side("a", "x"), "a").join(side("b", "y"), "b").where("x != y")
        links = scratch.store(apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    out = links.coalesce(1).mapInPandas(last, "node long, class long")
    while rounds:
        inner, outer = rounds.pop(), out.select(F.col("node").alias("class"), F.col("class").alias("top"))
        out = inner.join(outer, "class", "left").select("node", F.coalesce("top", "class").alias("class"))
    return scratch.store(out)


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of rows whose doc_id may be among wanted's, by one bit for each hash of an id: what is left out need not be shuffled to a join.

    The bits go to every task, 2 MB of them at most; where they are all taken every
    row passes, and the join that follows is exact in any case.
    """
    bits = min(MOST_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).collect()
    mask = np.zeros(bits >> 6, np.int64)
    for word, taken in words:
        mask[word] = taken
    shared = rows.sparkSession.sparkContext.broadcast(mask)

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 6] >> (x & 63) & 1).astype(bool))

    return rows.where(may(at))


def keyed_classes(docs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, class_id, class_key): a row a document with an id; the last two are the least (doc_id, text_key) of its class."""
    base = keyed_text(docs, id_col, text_col)
    ensure_checkpoint_dir(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        sketch = scratch.store(sketches(base.where("doc_id is not null")))
        one = sketch.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
        # Numbers of nodes hold from here on, as they are read from what was written.
        nodes = scratch.store(one.withColumn("node", F.monotonically_increasing_id()))
        buckets = shared_buckets(nodes, scratch)
        pairs = scratch.store(candidates(buckets))
        keys = nodes.select("node", F.col("first").alias("doc_id"), "text_key")
        met = buckets.select("node").distinct()
        wanted = scratch.store(keys.join(met, "node"))
        texts = likely(base.where("doc_id is not null"), wanted).withColumn("text_key", text_key("text")).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
        sets = scratch.store(weighted_sets(texts))
        links = scratch.store(links_of(pairs, sets, least))
        scratch.drop(pairs, wanted)
        label = components(links, scratch)
        apart = scratch.store(links_apart(buckets, label, sets, least, scratch))
        if not apart.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(apart), scratch)
        scratch.drop(buckets, sets)
        of = keys.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
        # Only nodes with links are in classes of several.
        least_of = of.join(label.select("node"), "node", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
        top = of.join(least_of, "class", "left").select("text_key", F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("least.text_key", "text_key").alias("class_key"))
        return sketch.select("doc_id", "text_key").join(scratch.store(top), "text_key").checkpoint()


def classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row a document; class_id is the least doc_id of its class.

    Documents of equal text are one node. Nodes are linked where the exact similarity
    of their five-word shingles (lower case, split at white space) is `least` or more;
    classes are what links connect. Empty and null texts are equal texts. A null id is
    its own class of null, unlinked. Rows that repeat give rows that repeat; rows of
    one id and different texts are documents of their own. Very long texts are read
    whole, each by itself. Other columns are not read.
    """
    known = keyed_classes(docs, least, id_col, text_col).select("doc_id", "class_id")
    none = keyed_text(docs, id_col, text_col).where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return known.unionByName(none)


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with one document of each class: that of least doc_id, of equal ids that of least text digest.

    Rows with a null id stay. Of rows that repeat both id and text one stays; where
    they differ in other columns it is any of them. Rows of one id and different texts
    stay or go each by its own class. Very long texts are read whole, each by itself.
    Columns go by number here, so that no name can clash.
    """
    held = {f"__row{k}": name for k, name in enumerate(docs.columns)}
    keyed = docs.select("*", F.col("doc_id").cast("long"), text_key("text")).toDF(*held, "__id", "__key")
    kept = keyed_classes(docs, least, "doc_id", "text").select(F.col("class_id").alias("__id"), F.col("class_key").alias("__key")).distinct()
    first = keyed.where("__id is not null").join(kept, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return first.select(*held).unionByName(keyed.where("__id is null").select(*held)).toDF(*docs.columns)
