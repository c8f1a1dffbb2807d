"""MinHash near-dedup with DartMinHash signatures.

A text is the set of its runs of five words. Each element owns a strip of the plane, as high as its
weight and endless in rank, into which darts fall at places given by its hash alone: so many a unit
of area as a Poisson draw says, looked up slab by slab until the rank bound that is expected to leave
no coordinate of the signature empty. Each dart belongs to one coordinate; the dart of least rank in
the text's region is the coordinate's value. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. Bands of the signature are joined, and every candidate pair is
verified on the exact shingle sets, so that chance agreements link nothing.

No large group is expanded into pairs. Texts with equal shingle sets are one from the start (an
aggregate with partial sums). In a band's group everybody is compared with the group's most central
text; the verified links give components (alternating large-star and small-star steps over tables in
the shared folder). Only groups that still hold several components are compared further, so that a
link that goes past the central text is not lost: small ones by pairs, large ones in blocks whose
exact comparison happens inside a task and gives only the links that join components. Bands are
chosen for a miss of under one in a million at the threshold. Candidates are neither capped nor
sampled.

Nodes are shingle sets, not rows: rows with equal sets are in one class by that, and rows that share an
id (or have none) but not a text are unlike each other like any others. Words are told apart by 64-bit
hashes, shingles by 64-bit hashes of these, sets by 128 bits.

Defined results: words are runs of letters, digits and non-ASCII characters, ASCII lower-cased; a text
with fewer words than a shingle has is one shingle; a text without words (or null) is its own class; a
null id sorts last and comes back as null; a class is named by the smallest id of its rows, so two
classes whose smallest rows share an id share their name; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _text as X
from ._scratch import drop, scratch
from .toxicity import IN_WORD, _LOWER

#: Tables of at most so many ids are broadcast, larger ones shuffled.
BROADCAST_IDS = 1_000_000
#: Groups of up to so many texts are compared by pairs, larger ones in blocks.
SMALL_GROUP = 12
PAIRS_AT_ONCE = 4096
BLOCK = 256


class DartMinHash:
    """Signatures of `size` coordinates for weighted sets."""

    def __init__(self, size: int = 128, seed: int = 5):
        self.size = size
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        self.darts = size * np.log(size) + 2 * size

    @staticmethod
    def _slabs(limit: float, first: float):
        """[0, first), [first, 2 first), ... up to the limit."""
        low, high, number = 0.0, first, 0
        while low < limit:
            yield number, low, high
            low, high, number = high, 2 * high, number + 1

    def signatures(self, elements: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """elements: 64-bit hashes, at: n + 1 offsets of the sets; sets must not be empty."""
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        total = np.add.reduceat(weights, at[:-1]) if n else np.empty(0)
        best = np.full(n * self.size, np.iinfo(np.uint64).max, np.uint64)
        bound, done = self.darts / np.maximum(total, 1e-300), np.zeros(n)
        open_ = np.ones(n, bool)
        while open_.any():
            self._throw(elements, weights, row, open_, done, bound, best)
            done = np.where(open_, bound, done)
            bound = np.where(open_, 2 * bound, bound)
            open_ &= (best.reshape(n, self.size) == np.iinfo(np.uint64).max).any(axis=1)
        return best.reshape(n, self.size)

    def _throw(self, elements, weights, row, open_, done, bound, best) -> None:
        """Darts with a rank in [done, bound) of the open sets."""
        for w_number, w_low, w_high in self._slabs(float(weights.max()), 1.0):
            for r_number, r_low, r_high in self._slabs(float(bound[open_].max()), 0.25):
                use = np.flatnonzero(open_[row] & (weights > w_low) & (bound[row] > r_low) & (done[row] < r_high))
                if not len(use):
                    continue
                slab = X.mix(np.array([self.seed + np.uint64(w_number * 4096 + r_number + 1)], np.uint64))[0]
                base = X.mix(elements[use] ^ slab)
                count = _poisson(base, (w_high - w_low) * (r_high - r_low))
                hit = count > 0
                use, base, count = use[hit], base[hit], count[hit]
                number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                darts = X.mix(np.repeat(base, count) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
                use = np.repeat(use, count)
                second = X.mix(darts ^ np.uint64(0xA24BAED4963EE407))
                rank = r_low + (second >> np.uint64(11)).astype(np.float64) * (2.0**-53 * (r_high - r_low))
                keep = (rank < bound[row[use]]) & (rank >= done[row[use]])
                if w_high > 1 or weights.min() < 1:
                    third = X.mix(second + np.uint64(0x9FB21C651E98DF25))
                    height = w_low + (third >> np.uint64(11)).astype(np.float64) * (2.0**-53 * (w_high - w_low))
                    keep &= height < weights[use]
                use, darts, rank = use[keep], darts[keep], rank[keep]
                # a non-negative float orders as its bits do; the dart's name takes the low half
                key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (darts & np.uint64(0xFFFFFFFF))
                np.minimum.at(best, row[use] * self.size + ((darts >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64), key)


def _poisson(hashes: np.ndarray, mean: float) -> np.ndarray:
    """Poisson draws given by hashes."""
    terms, term, k = [], np.exp(-mean), 0
    while not terms or terms[-1] < 1 - 1e-12 and k < mean + 60 * (1 + mean**0.5):
        terms.append((terms[-1] if terms else 0.0) + term)
        k += 1
        term *= mean / k
    return np.searchsorted(np.array(terms), (hashes >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and their n + 1 offsets."""
    low = _LOWER[data]
    starts, ends, at = X.words(low, offsets, IN_WORD)
    hashes = X.word_hashes(low, starts, ends, 5)
    size = np.diff(at)
    row, made = [], []
    long = np.flatnonzero(size >= words)
    if len(long):
        runs = X.chained([hashes[k : len(hashes) - words + 1 + k] for k in range(words)], words)
        count = size[long] - words + 1
        place = np.repeat(at[long] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        made.append(runs[place])
        row.append(np.repeat(long, count))
    for n in range(1, words):  # a shorter text is one shingle
        short = np.flatnonzero(size == n)
        if len(short):
            made.append(X.chained([hashes[at[short] + k] for k in range(n)], n))
            row.append(short)
    if not made:
        return np.empty(0, np.uint64), np.zeros(len(size) + 1, np.int64)
    row, made = np.concatenate(row), np.concatenate(made)
    order = np.lexsort((made, row))
    row, made = row[order], made[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (made[1:] != made[:-1])]
    return made[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def _signed(words: int, bands: int, rows: int):
    hasher = DartMinHash(bands * rows)

    def run(batches):
        for batch in batches:
            ids = X.ids_of(batch.column(0))
            for first, data, offsets in X.slices(batch.column(2)):
                n = len(offsets) - 1
                elements, at = shingle_sets(data, offsets, words)
                filled = np.flatnonzero(np.diff(at) > 0)
                signature = hasher.signatures(elements, np.ones(len(elements)), np.r_[at[filled], at[-1]]) if len(filled) else np.empty((0, bands * rows), np.uint64)
                keys = np.zeros((len(filled), bands), np.uint64)
                for i in range(rows):
                    keys = X.mix(keys * np.uint64(3) + signature[:, i::rows])
                names = np.zeros((2, n), np.uint64)
                if len(filled):
                    for i, salt in enumerate((1, 2)):
                        names[i, filled] = np.add.reduceat(X.chained([elements], salt), at[filled])
                has = np.zeros(n, np.int64)
                has[filled] = bands
                put = np.r_[0, np.cumsum(has)].astype(np.int32)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(elements.astype("<u8"))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[first : first + n]), batch.column(1).slice(first, n), pa.array(np.diff(at)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(put), pa.array(keys.ravel().view(np.int64))), blobs,
                ], names=["id", "mark", "n", "name1", "name2", "bands", "shingles"])

    return run


def _verify(threshold: float):
    """Of rows in which a set (side 0) comes before those it is to be compared with (side 1), the pairs
    that are as similar as the threshold says."""

    def run(batches):
        first = None
        for batch in batches:
            side, blobs, keep = batch.column(2).to_numpy(), batch.column(4), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                y = np.frombuffer(blobs[i].as_buffer(), "<u8")
                if not side[i]:
                    first = y.copy()
                elif min(len(first), len(y)) >= threshold * max(len(first), len(y)):
                    common = len(np.intersect1d(first, y, assume_unique=True))
                    keep[i] = common >= threshold * (len(first) + len(y) - common) - 1e-9
            yield batch.select([0, 3]).filter(pa.array(keep))

    return run


def _sets_of(signed: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and shingles of the named sets, each read from the one row that stands for it."""
    named = scratch(sets.join(reps, "rep", "left_semi").select("rep", "name1", "name2", F.col("least.id").alias("id"), F.col("least.mark").alias("mark")))
    few = named.count() <= BROADCAST_IDS  # else the rows that stand for a set are shuffled
    rows = signed.select("id", "mark", "name1", "name2", "shingles").join(F.broadcast(named) if few else named, ["id", "mark", "name1", "name2"])
    found = scratch(rows.select("rep", "shingles").dropDuplicates(["rep"]))
    drop(named)
    return found


def _links(signed: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as the threshold says. Each set of an a is sent
    once for up to `PAIRS_AT_ONCE` of its pairs, and a hub's pairs are dealt out accordingly, so neither
    its set nor its group meets in one task."""
    pairs = scratch(pairs)
    found = _sets_of(signed, sets, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_AT_ONCE)
    dealt = pairs.join(hot, "a", "left").select("a", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS_AT_ONCE))).cast("int").alias("part"), "b")
    firsts = dealt.select("a", "part").distinct().join(found.withColumnRenamed("rep", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "shingles")
    others = dealt.join(found.withColumnRenamed("rep", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "shingles")
    rows = firsts.union(others).repartition("a", "part").sortWithinPartitions("a", "part", "side", "b")
    out = scratch(rows.mapInArrow(_verify(threshold), "a long, b long"))
    drop(pairs, found)
    return out


def _pairs_of_small_groups(open_: DataFrame) -> DataFrame:
    """Each member outside its group's largest component with the members of other components, but
    for the hub, which has met everybody."""
    small = open_.where("root <> largest").select("band", "key", F.col("rep").alias("a"), F.col("root").alias("ra"))
    other = open_.select("band", "key", "hub", F.col("rep").alias("b"), F.col("root").alias("rb"), "largest")
    pairs = small.join(other, ["band", "key"]).where("ra <> rb and (rb = largest or a < b) and a <> hub and b <> hub")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(threshold: float):
    def run(key, table):
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        ids, roots = (table.column(c).to_numpy() for c in ("rep", "root"))
        few = int((table.column("side").to_numpy() == 0).sum())
        sets = [np.frombuffer(b.as_buffer(), "<u8") for b in table.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        names, place = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.repeat(np.arange(len(sets)), sizes)
        common = np.zeros((few, len(sets) - few), np.float32)
        for at in range(0, len(names), 4096):  # exact counts below 2**24
            part = (place >= at) & (place < at + 4096)
            has = np.zeros((len(sets), min(4096, len(names) - at)), np.float32)
            has[member[part], place[part] - at] = 1
            common += has[:few] @ has[few:].T
        near = common >= threshold * (sizes[:few, None] + sizes[None, few:] - common) - 1e-6
        near &= roots[:few, None] != roots[None, few:]
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(near)):  # links that join components, no others
            a, b = find(int(roots[x])), find(int(roots[few + y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[few + y])))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return run


def _links_in_blocks(signed: DataFrame, sets: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """Links between the components of large groups: the members outside the largest component, and
    all members, are cut into blocks of bounded size, each block of the first meets each of the
    second in one task, and what comes out are the links that join components."""
    large = large.where("rep <> hub")
    found = _sets_of(signed, sets, large.select("rep").distinct())
    few_blocks, all_blocks = (F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int") for c in (F.col("size") - F.col("most"), F.col("size")))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = large.where("root <> largest").select("band", "key", dealt(few_blocks).alias("i"), every(all_blocks).alias("j"), F.lit(0).alias("side"), "rep", "root")
    rest = large.select("band", "key", every(few_blocks).alias("i"), dealt(all_blocks).alias("j"), F.lit(1).alias("side"), "rep", "root")
    rows = few.union(rest).join(found, "rep").select("band", "key", "i", "j", "side", "rep", "root", "shingles")
    out = scratch(rows.groupBy("band", "key", "i", "j").applyInArrow(_block_links(threshold), "a long, b long").distinct())
    drop(found)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes that have links."""
    edges = scratch(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, scratch(small)
        drop(before)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """id (NULL_ID for null) and mark (a hash of the text) of each row, and least, the smallest (id,
    mark) of its class."""
    source = X.bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), mark_of(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    signed = scratch(source.mapInArrow(_signed(words, bands, rows), "id long, mark long, n long, name1 long, name2 long, bands array<long>, shingles binary"))
    sets = signed.where("n > 0").groupBy("name1", "name2").agg(F.min(F.struct("id", "mark")).alias("least"), F.first("bands").alias("bands"))
    sets = scratch(sets.withColumn("rep", F.monotonically_increasing_id()))  # once written, the numbers stay
    entries = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    groups = entries.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch(entries.join(groups, ["band", "key"]).select("band", "key", "size", "rep"))
    # the hub of a group is its most central text: the one that meets most others over all bands
    central = shared.groupBy("rep").agg(F.sum("size").alias("meets"))
    entries = shared.join(central, "rep")
    hubs = entries.groupBy("band", "key").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("hub"))
    entries = scratch(entries.join(hubs, ["band", "key"]).select("band", "key", "size", "hub", "rep"))
    drop(shared)
    linked = _links(signed, sets, entries.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), threshold)
    first = scratch(components(linked))
    # groups that still hold several components
    labelled = entries.join(first, entries.rep == first.node, "left").select("band", "key", "size", "hub", "rep", F.coalesce("root", "rep").alias("root"))
    parts = labelled.groupBy("band", "key", "root").agg(F.count("*").alias("own"))
    mixed = parts.groupBy("band", "key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("own", "root")).alias("largest"), F.max("own").alias("most")).where("roots > 1")
    open_ = scratch(labelled.join(mixed.select("band", "key", "largest", "most"), ["band", "key"]))
    drop(entries, first)
    more = _links(signed, sets, _pairs_of_small_groups(open_.where(F.col("size") <= SMALL_GROUP)), threshold)
    large = open_.where(F.col("size") > SMALL_GROUP)
    if large.head(1):
        more = more.union(_links_in_blocks(signed, sets, large, threshold))
    # the smallest row of a component is the smallest of those of its sets
    rooted = sets.select("rep", "name1", "name2", "least").join(components(linked.union(more)).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = scratch(rooted)
    drop(sets, linked, open_)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("class"))
    named = rooted.join(smallest, "root").select("name1", "name2", F.col("class").alias("least"))
    classed = signed.where("n > 0").select("id", "mark", "name1", "name2").join(named, ["name1", "name2"]).select("id", "mark", "least")
    return classed.union(signed.where("n = 0").select("id", "mark", F.struct("id", "mark").alias("least")))


def mark_of(text) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text.cast("string"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col and class_id, the smallest id of the row's class: texts linked, over any number of
    steps, by a Jaccard similarity of their shingle sets of at least `threshold`."""
    of = lambda c: F.when(c != X.NULL_ID, c)
    return classes(docs, id_col, text_col, **options).select(of(F.col("id")).alias(id_col), of(F.col("least.id")).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each class the row with the smallest id (of several, that with the smallest hash of its text;
    of equal rows, one), with all columns of docs."""
    found = classes(docs, id_col, text_col, **options)
    key, mark = X.free_names(docs.columns, "_id", "_mark")
    kept = found.where(F.struct("id", "mark") == F.col("least")).select(F.col("id").alias(key), F.col("mark").alias(mark)).distinct()
    rows = docs.withColumn(key, F.coalesce(F.col(X.quoted(id_col)).cast("long"), F.lit(X.NULL_ID))).withColumn(mark, mark_of(F.col(X.quoted(text_col))))
    left = rows.join(kept, [key, mark], "left_semi")
    # the join leaves rows dealt out and sorted by both, which is all that the window needs
    (place,) = X.free_names(left.columns, "_place")
    one = F.row_number().over(Window.partitionBy(key, mark).orderBy(key, mark))
    return left.withColumn(place, one).where(F.col(place) == 1).select(*map(X.quoted, docs.columns))
