"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: weight = damped term
frequency times damped inverse document frequency. The document frequencies of
all documents are gathered in a counting sketch of fixed size, so that what is
broadcast is bounded; it is accurate for shingles in more than about a
thousandth of the documents, and rarer ones all count as rare. Both factors
are damped (at most 1.25 for a rare shingle against one in every document), so
that a group of copies, however large, does not take the weight from its own
shingles; the damped inverse frequency has eight levels, so that the samples of
shingles that occur once come from tables.

Each distinct text gets consistent weighted samples (Ioffe 2010): two texts
agree in a sample with a probability equal to their weighted Jaccard
similarity. Bands of samples give buckets of candidates. Buckets are dealt to
blocks of bounded size, which hold the texts of their members; in a block every
pair that agrees plausibly is verified by exact weighted Jaccard similarity,
unless the links found so far connect it anyway. Of a bucket with several
blocks, one member of each linked group meets those of the other blocks; then
what is still in different classes is compared across blocks, so that no
plausible pair of one bucket is left unverified between two classes. The
classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import added, blocks_of, cut, documents, joined_to_key, small, unused
from slotwise.llm.words import batch_hashes, mix, runs, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4  # at a similarity of 0.8 a pair shares no band once in 37,000
SAMPLES = BANDS * ROWS
PLAUSIBLE = 0.64  # share of equal samples (standard error 0.045 at 0.8) below which no pair is verified
BUCKETS = 2**18  # of the document frequency sketch
BLOCK = 4096  # sketch buckets in a row while it is added up
PART = 256  # expected members compared with each other at a time
VARIATES = 2**12  # rows of random variates, chosen by shingle hash
LEVELS = 1 + 0.25 * np.arange(8) / 7  # damped inverse document frequency, from frequent to rare
DENSE = 2**22  # entries of a block's table of weights, at most


def batch_counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and how often it occurs there, ascending, for the
    distinct shingles of several texts. A text of fewer words than a shingle
    has one of all its words."""
    words, text = batch_hashes(texts)
    wide = shingles(words, SHINGLE) if len(words) >= SHINGLE else words[:0]
    whole = text[: len(wide)] == text[SHINGLE - 1 :][: len(wide)]
    count = np.bincount(text, minlength=len(texts))
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    own = [shingles(words[begin[i] : begin[i] + count[i]], SHINGLE) for i in short]
    number, found = np.concatenate([text[: len(wide)][whole], short]), np.concatenate([wide[whole], *own])
    order = np.lexsort((found, number))
    number, found = number[order], found[order]
    first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (number[1:] != number[:-1])][: len(found)])
    return number[first], found[first], np.diff(np.r_[first, len(found)])


def bucket_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Number of documents per sketch bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in runs(t.as_py() for t in batch.column("text")):
                total += np.bincount(bucket_of(batch_counted(texts)[1]), minlength=BUCKETS)
        yield blocks_of(total.reshape(-1, BLOCK))

    blocks = added(docs.select("text").mapInArrow(count, "block int, values binary"))
    return np.concatenate([blocks.get(b, np.zeros(BLOCK)) for b in range(BUCKETS // BLOCK)])


def rarity(frequency: np.ndarray, n: int) -> np.ndarray:
    """Level of the damped inverse document frequency per bucket: the lowest
    for a shingle in every document, the highest for one in a thousandth or less."""
    share = np.maximum(frequency, 1) / max(n, 1)
    return np.rint(7 * np.clip(-np.log(np.minimum(share, 1)) / math.log(1000), 0, 1)).astype(np.uint8)


def weights(shingle: np.ndarray, tf: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * LEVELS[levels[bucket_of(shingle)]]


def weighted(text: str, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, shingle, tf = batch_counted([text])
    return shingle, weights(shingle, tf, levels)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: shared weight over united weight."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared, one, other = np.minimum(a[1][i], b[1][j]).sum(), a[1].sum(), b[1].sum()
    return float(shared / (one + other - shared)) if one + other > 0 else 1.0


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, ...]:
    """The variates r, log c and beta, and for weights of each level the
    quantised weight and the value that the samples minimise."""
    g = np.random.Generator(np.random.PCG64(31))
    r = g.gamma(2, 1, (VARIATES, SAMPLES)).astype(np.float32)
    log_c, beta = np.log(g.gamma(2, 1, (VARIATES, SAMPLES))).astype(np.float32), g.random((VARIATES, SAMPLES), np.float32)
    step = [np.floor(np.float32(math.log(w)) / r + beta) for w in LEVELS]
    value = np.concatenate([log_c - r * (t - beta + 1) for t in step])
    return r, log_c, beta, np.concatenate(step).astype(np.int16), value


def samples(shingle: np.ndarray, tf: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of a set, ascending by hash; a sample
    names the shingle and the quantised weight. An empty set has the samples of
    an empty set."""
    r, log_c, beta, steps, values = _variates()
    best, chosen = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    column = np.arange(SAMPLES)
    row = (shingle >> np.uint64(40)).astype(np.int64) & (VARIATES - 1)
    often = np.flatnonzero(tf > 1)
    for a in range(0, len(shingle), 1024):
        at = row[a : a + 1024] + level[a : a + 1024].astype(np.int64) * VARIATES
        value = values[at]
        here = often[(often >= a) & (often < a + 1024)]
        if len(here):
            rr, bb = r[row[here]], beta[row[here]]
            log_w = np.log((1 + np.log(tf[here])) * LEVELS[level[here]]).astype(np.float32)[:, None]
            t_often = np.floor(log_w / rr + bb)
            value[here - a] = log_c[row[here]] - rr * (t_often - bb + 1)
        first = value.argmin(axis=0)  # equal variates fall to the smaller hash
        low = value[first, column]
        t = steps[at[first], column].astype(np.int64)
        if len(here):
            place = np.full(len(at), -1)
            place[here - a] = np.arange(len(here))
            mine = place[first]
            t = np.where(mine >= 0, t_often[np.maximum(mine, 0), column].astype(np.int64), t)
        ids = mix(shingle[a : a + 1024][first] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        better = low < best
        best, chosen = np.where(better, low, best), np.where(better, ids, chosen)
    return chosen


def band_keys(s: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), BANDS))
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0xA24BAED4963EE407) + s.reshape(len(s), BANDS, ROWS)[:, :, k])
    return keys.view(np.int64)


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def sketched(docs: DataFrame, levels) -> DataFrame:
    """doc_id, node (MD5 of the text), sk (one byte a sample), keys (one a band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, node = np.zeros((batch.num_rows, SAMPLES), np.uint64), []
            for a, texts in runs(t.as_py() for t in batch.column("text")):
                node += [_digest(t) for t in texts]
                number, shingle, tf = batch_counted(texts)
                level = levels.value[bucket_of(shingle)]
                ends = np.searchsorted(number, np.arange(len(texts) + 1))
                for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    s[a + i] = samples(shingle[low:high], tf[low:high], level[low:high])
            keys = band_keys(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(node) + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            sk = [x.tobytes() for x in (s & np.uint64(255)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.binary()), pa.array(sk, pa.binary()), lists], ["doc_id", "node", "sk", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node binary, sk binary, keys array<long>")


# ---- blocks


def agreement(sk: np.ndarray) -> np.ndarray:
    """Share of equal samples of each two rows."""
    like = np.empty((len(sk), len(sk)), np.float32)
    for a in range(0, len(sk), 64):
        like[a : a + 64] = (sk[a : a + 64, None, :] == sk[None, :, :]).mean(axis=2, dtype=np.float32)
    return like


def similarities(texts: list[str], levels: np.ndarray):
    """A function (i, [j]) that gives the exact weighted Jaccard similarities
    of text i to some others."""
    number, shingle, tf = batch_counted(texts)
    w = weights(shingle, tf, levels)
    total = np.bincount(number, w, minlength=len(texts))
    names, column, count = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = count[column.ravel()] > 1  # what one text alone holds is in no intersection
    place = np.cumsum(count > 1) - 1
    width = int((count > 1).sum())
    if len(texts) * width <= DENSE:
        table = np.zeros((len(texts), width))
        table[number[shared], place[column.ravel()[shared]]] = w[shared]

        def common(i: int, others: np.ndarray) -> np.ndarray:
            return np.minimum(table[i], table[others]).sum(axis=1)
    else:  # very long texts
        ends = np.searchsorted(number, np.arange(len(texts) + 1))
        sets = [(shingle[a:b], w[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

        def common(i: int, others: np.ndarray) -> np.ndarray:
            out = []
            for j in others:
                _, x, y = np.intersect1d(sets[i][0], sets[j][0], assume_unique=True, return_indices=True)
                out.append(np.minimum(sets[i][1][x], sets[j][1][y]).sum())
            return np.array(out)

    def of(i: int, others: np.ndarray) -> np.ndarray:
        both = common(i, others)
        united = total[i] + total[others] - both
        return np.where(united > 0, both / np.maximum(united, 1e-300), 1.0)

    return of


def families(plausible: np.ndarray, similarity, group: np.ndarray) -> np.ndarray:
    """The class of each member after all plausible pairs of different classes
    are verified; ``group`` gives the classes at the start."""
    group = group.copy()
    for i in np.argsort(-plausible.sum(axis=1), kind="stable"):  # the best connected first
        others = np.flatnonzero(plausible[i] & (group != group[i]))
        if len(others):
            for j in others[similarity(i, others) >= THRESHOLD - 1e-12]:
                group[group == group[j]] = group[i]
    return group


def _parts(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by its first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            now = tuple(k[a] for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _sketches(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sk").to_pylist()), np.uint8).reshape(-1, SAMPLES)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], ["key", "a", "b"])


def linked(members: DataFrame, levels) -> DataFrame:
    """From (key, part, node, sk, text): for each member of a block the link
    (key, a, b) from its class there to it, a being the class's smallest node.
    A class's own smallest node comes as (key, a, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _parts(batches, 2):
            node = group.column("node").to_pylist()  # ascending
            plausible = agreement(_sketches(group)) >= PLAUSIBLE
            np.fill_diagonal(plausible, False)
            found = np.arange(len(node))
            if plausible.any():
                found = families(plausible, similarities(group.column("text").to_pylist(), levels.value), found)
            low = {c: i for i, c in reversed(list(enumerate(found.tolist())))}
            key = group.column("key")[0].as_py()
            yield _links([(key, node[low[c]], node[i]) for i, c in enumerate(found.tolist())])

    dealt = members.select("key", "part", "node", "sk", "text").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(run, "key long, a binary, b binary")


def crossed(tagged: DataFrame, members: DataFrame, levels) -> DataFrame:
    """Links (a, b) between classes that share a bucket: from (key, node, root)
    of buckets with several classes, and (node, sk, text).

    A bucket's members are dealt to parts, small classes together and large
    ones apart, and each two parts, but those of one class, make a block. First
    only the samples meet; the texts go where a pair agrees plausibly."""
    sizes = tagged.groupBy("key", "root").agg(F.count("*").alias("size"))
    none = F.lit(b"")
    sizes = sizes.withColumn("g", F.when(F.col("size") < PART, none).otherwise(F.col("root")))
    groups = cut(sizes.groupBy("key", "g").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts")))
    own = cut(sizes.where(F.col("size") >= PART).select("key", "root", "g"))
    placed = tagged.join(small(own), ["key", "root"], "left").withColumn("g", F.coalesce("g", none)).join(small(groups), ["key", "g"])
    dealt = F.when(F.col("g") == none, F.xxhash64("root", "key")).otherwise(F.xxhash64("node", "key"))
    placed = placed.withColumn("i", F.pmod(dealt, "parts").cast("int")).select("key", "g", "i", "node", "root")
    other = groups.select("key", F.col("g").alias("h"), F.col("parts").alias("of_h"))
    both = groups.join(other, "key").where((F.col("g") < F.col("h")) | ((F.col("g") == F.col("h")) & (F.col("g") == none)))
    blocks = both.select("key", "g", "h", "of_h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).select("key", "g", "h", "i", F.explode(F.sequence(F.lit(0), F.col("of_h") - 1)).alias("j"))
    blocks = cut(blocks.where("g < h or i <= j").withColumn("block", F.xxhash64("key", "g", "h", "i", "j")))
    sides = blocks.select("key", "g", "i", "block", F.lit(0).alias("side")).unionByName(blocks.where("g < h or i < j").select("key", F.col("h").alias("g"), F.col("j").alias("i"), "block", F.lit(1).alias("side")))
    met = sides.join(placed, ["key", "g", "i"]).select("block", "side", "node", "root")

    def plausible(group: pa.Table) -> np.ndarray:
        side, root = group.column("side").to_numpy(), np.array(group.column("root").to_pylist(), dtype=object)
        ok = (agreement(_sketches(group)) >= PLAUSIBLE) & (root[:, None] != root[None, :])
        return ok & (side[:, None] != side[None, :]) if side.any() else ok

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _parts(batches, 1):
            keep = plausible(group).any(axis=1)
            yield from group.drop_columns(["sk"]).filter(pa.array(keep)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _parts(batches, 1):
            root = group.column("root").to_pylist()
            number = {r: i for i, r in enumerate(sorted(set(root)))}
            start = np.array([number[r] for r in root])
            found = families(plausible(group), similarities(group.column("text").to_pylist(), levels.value), start)
            ends = {(int(c), r) for c, r in zip(found, root, strict=True)}
            low: dict[int, bytes] = {}
            for c, r in sorted(ends, key=lambda e: e[1]):
                low.setdefault(c, r)
            yield _links([(0, low[c], r) for c, r in sorted(ends) if low[c] != r])

    by_block = lambda rows: rows.repartition("block").sortWithinPartitions("block", "side", "node")
    close = by_block(met.join(members.select("node", "sk"), "node").select("block", "side", "node", "root", "sk")).mapInArrow(near, "block long, side int, node binary, root binary")
    full = cut(close).join(members, "node").select("block", "side", "node", "root", "sk", "text")
    return by_block(full).mapInArrow(verify, "key long, a binary, b binary").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of the
    edges (a, b), by repeated hooking to the smallest neighbour and shortcuts."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        hooked = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = fresh(hooked.join(up, "root").select("node", F.least("root", "above").alias("root"), "was"))
        labels = nxt.select("node", "root")
        if nxt.where("root <> was").isEmpty():
            return labels


def fresh(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut and without the estimate of its size: joins
    multiply estimates, so over several rounds these would grow to numbers
    that take longer to compute than the rounds."""
    spark, j = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(j.queryExecution().toRdd(), j.schema(), False), spark)


def connected(rows: DataFrame, nodes: DataFrame, levels) -> DataFrame:
    """node, root over all verified links, from the documents and
    (node, low, n, sk, keys); nodes without a link may be missing."""
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    buckets = exploded.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("print")).where("n > 1")
    # members that share several bands meet once: such buckets have one size and one sum of hashes
    buckets = cut(buckets.dropDuplicates(["n", "print"]).select("key", "n"))
    in_bucket = exploded.join(small(buckets), "key").groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("b"))  # at most one a band
    needed = cut(in_bucket.join(nodes.select("node", "low", "sk"), "node"))
    texts = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))
    chosen = small(needed.select("node", "low"))
    # the row with the smallest id, so that copies don't meet in one task
    held = texts.join(chosen.withColumnRenamed("node", "want"), (F.col("node") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("low"))).select("node", "text").dropDuplicates(["node"])
    members = cut(needed.join(held, "node").select("node", "sk", "text", "b"))
    in_buckets = members.select("node", "sk", "text", F.explode("b").alias("b")).select("node", "sk", "text", "b.key", "b.n")
    level = cut(linked(in_buckets.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / PART)).cast("int")), levels))
    edges, large = level.where("a <> b").select("a", "b"), buckets.where(F.col("n") > PART)
    again = large
    while not again.isEmpty():
        # one member of each class in a block meets those of the bucket's other blocks, as long as they halve
        heads = level.where("a = b").select("key", F.col("a").alias("node")).join(again.withColumnRenamed("n", "was"), "key")
        fewer = cut(heads.groupBy("key").agg(F.count("*").alias("n"), F.max("was").alias("was")).where("n > 1 and n <= was / 2").select("key", "n"))
        meet = heads.select("key", "node").join(fewer, "key").join(members.select("node", "sk", "text"), "node")
        level = cut(linked(meet.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / PART)).cast("int")), levels))
        edges, again = edges.unionByName(level.where("a <> b").select("a", "b")), fewer.where(F.col("n") > PART)
    labels = components(edges)
    if not large.isEmpty():
        tagged = members.select("node", F.explode("b.key").alias("key")).join(large.select("key"), "key").join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        apart = tagged.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("key")
        tagged = fresh(tagged.join(apart, "key"))
        if not tagged.isEmpty():
            more = cut(crossed(tagged, members.select("node", "sk", "text"), levels))
            if not more.isEmpty():
                labels = components(edges.unionByName(more))
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, first: one row per document. node is the MD5 of
    its text, class_id the smallest doc_id of its class, and first is true for
    the rows of one text with that id, so for one row if ids are unique.

    Equal texts are always of one class, whatever their length; so are all
    empty and null texts. A text of fewer than five words is one shingle, and a
    very long one is compared whole. Rows with a null doc_id take part, and
    have a null class_id where the class holds no id; repeated rows are of one
    class, and further columns, whatever their names, play no part. An empty
    table gives no rows.
    """
    rows = documents(docs)
    levels = docs.sparkSession.sparkContext.broadcast(rarity(frequencies(rows), rows.count()))
    signed = cut(sketched(rows, levels))
    # copies of a text are one row, with their smallest id, until the end
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("sk").alias("sk"), F.first("keys").alias("keys")))
    labels = connected(rows, nodes, levels)
    groups = cut(nodes.select("node", "low", "n").join(labels, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root")))
    classes = groups.groupBy("root").agg(F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("head"), F.count("*").alias("nodes"))
    several = groups.groupBy("root").agg(F.count("*").alias("n"))
    named = joined_to_key(groups.select("node", "root"), classes.select("root", "class_id", "head"), "root", several).select("node", "class_id", (F.col("node") == F.col("head.node")).alias("head"))
    every = joined_to_key(signed.select("doc_id", "node"), named, "node", groups.select("node", "n"))
    first = F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return every.select("doc_id", "node", "class_id", first.alias("first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one of each class. A
    row that repeats another in id and text goes, too. Nulls, short and long
    texts, empty tables: as in ``near_duplicates``."""
    found = cut(near_duplicates(docs).groupBy("doc_id", "node").agg(F.max("first").alias("first"), F.count("*").alias("n")))
    own, of = unused(docs, "own_id"), unused(docs, "text_hash")
    marked = docs.withColumns({own: F.col("doc_id").cast("long"), of: F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))})

    def among(which: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        which = small(which.select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node")))
        return rows.join(which, F.col(own).eqNullSafe(F.col("gone_id")) & (F.col(of) == F.col("gone_node")), how)

    kept = among(found.where(~F.col("first")), "left_anti", marked)
    again = found.where("first and n > 1")
    if not again.isEmpty():
        kept = among(again, "left_anti", kept).unionByName(among(again, "left_semi", kept).dropDuplicates([own, of]))
    return kept.drop(own, of)
