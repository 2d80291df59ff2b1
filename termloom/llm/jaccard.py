"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets of word shingles whose Jaccard similarity is t or more, with sizes in one band [l, l / t), differ in at
most k elements. The feature domain is dealt by hash into n1 groups of N2 partitions, and every subset of KEPT of a group's
partitions is a signature: its hash over the set's elements in those partitions. A group with at most N2 - KEPT differences keeps a
subset that no difference touches, and n1 is such that k differences, however they fall, leave several. A set signs for
its own band and for the next, which any partner's band is one of.

Nodes are distinct sets, so copies cost nothing. Similar sets share not one signature but a known number
at least, so pairs must share several; sets of signatures that very many share are tied to one pivot. What
such pairs and ties connect is a cluster, and a cluster's sets are compared block by block, exactly. A block pair
returns a spanning forest of its links, never all pairs.

Up to the clusters a set goes by a 64-bit key, for which sets that collide would only be compared in vain; what is linked, by
128 bits. Groups that may hold much of the table are split: hot signatures by salts (a sample tells which), clusters
into blocks, and rows of one set or component are joined by broadcast where they are more than 1 / HOT_KEYS of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from termloom.llm.bytesvec import Words, mix
from termloom.llm.common import slices, staged, unstage

#: Partitions of a group, and how many of them a signature takes.
N2, KEPT = 3, 2
#: Signatures that two sets have to share, and from how many sets on a signature counts as hot.
COMMON, HOT = 3, 16
#: Join keys with more than a 1 / HOT_KEYS of all rows (HOT_KEYS at most) are joined by broadcast.
HOT_KEYS = 2000
_COEF = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash) of the distinct shingles in order of document, and shingles for each document.

    Words are lower-cased in A-Z. A text of fewer words than width has one shingle, all of it; one without words, none.
    """
    words = Words(column, lower=True)
    n, first, h = words.count, words.first_word(), words.hash
    long_enough = np.flatnonzero(first[words.doc] + n[words.doc] - np.arange(len(h)) >= width) if len(h) else np.zeros(0, np.int64)
    value = np.zeros(len(long_enough), np.uint64)
    for k in range(width):
        value = mix(value * _COEF[4] + h[long_enough + k] * _COEF[k % 4] + np.uint64(k))
    doc = words.doc[long_enough]
    short = np.flatnonzero((n > 0) & (n < width))
    tail = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        there = n[short] > k
        at = np.where(there, first[short] + k, 0)
        tail = np.where(there, mix(tail * _COEF[4] + h[at] * _COEF[k % 4] + np.uint64(1000 + k)), tail)
    doc, value = np.concatenate([doc, short]), np.concatenate([value, tail])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return doc, value, np.bincount(doc, minlength=words.n_docs)


def set_keys(doc: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 128-bit key for each document's set, as two columns of integers: equal sets have equal keys."""
    out = np.zeros((len(count), 2), np.uint64)
    for k in (0, 1):
        np.add.at(out[:, k], doc, mix(value * _COEF[k + 2] ^ _COEF[1 + k]))
        out[:, k] = mix(out[:, k] + count.astype(np.uint64) * _COEF[k])
    return out


def _binary(keys: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Keys as 16 bytes each; null where mask is set."""
    whole = np.ascontiguousarray(keys)
    fixed = pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(whole.tobytes())])
    cells = fixed.cast(pa.binary())
    return cells if mask is None else pc.if_else(pa.array(mask), pa.scalar(None, pa.binary()), cells)


class Bands:
    """The size bands and their numbers of groups for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.t = num / den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, math.floor(self.lows[-1] * den / num) + 1))
        self.low_array = np.array(self.lows)
        self.num, self.den = num, den

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low_array, size, "right") - 1

    def differ(self, scheme: np.ndarray) -> np.ndarray:
        """k for pairs whose larger set is in the band `scheme`: |a ^ b| <= (a + b)(1 - t) / (1 + t), in integers, sizes below the next band."""
        most = self.low_array[scheme + 1] - 1
        return 2 * most * (self.den - self.num) // (self.den + self.num)


def intact(k: int, n1: int) -> int:
    """Subsets that k differences leave untouched, at least: most are lost if they fall evenly on the groups."""
    each, more = divmod(k, n1)
    left = lambda d: math.comb(max(N2 - d, 0), KEPT)
    return (n1 - more) * left(each) + more * left(each + 1)


@cache
def n_groups(k: int) -> int:
    """The least n1 that leaves COMMON subsets, and a few more for those that turn out hot."""
    n1 = k // (N2 - KEPT + 1) + 1
    while intact(k, n1) < COMMON + 2 + k // 16:
        n1 += 1
    return n1


_SUBSETS = np.array(list(combinations(range(N2), KEPT)))


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, tag) of all sets, for their own band and the next.

    Subsets without any element, which many sets share, aren't signed; a set then shares at least bound = intact() - (its
    empty ones) signatures with any partner. Where that is below COMMON the set signs empty ones too. tag is twice the most hot
    signatures that still leave COMMON others (bound - COMMON; 0 where empty ones are signed), plus the step.
    """
    sigs, owners, tags = [], [], []
    for step in (0, 1):
        scheme = bands.of(np.maximum(count, 1)) + step
        k = bands.differ(scheme)
        distinct, back = np.unique(k, return_inverse=True)
        n1 = np.where(count > 0, np.array([n_groups(int(x)) for x in distinct], np.int64)[back], 0)
        sure = np.array([intact(int(x), n_groups(int(x))) for x in distinct], np.int64)[back]
        base = np.cumsum(n1 * N2) - n1 * N2
        cells = int((n1 * N2).sum())
        if not cells:
            continue
        s = mix(value + scheme[doc].astype(np.uint64) * _COEF[2])
        # the part by the upper half of the mixed value
        part = ((s >> np.uint64(32)) * (n1 * N2)[doc].astype(np.uint64)) >> np.uint64(32)
        cell = base[doc] + part.astype(np.int64)
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, mix(s + _COEF[3]))
        filled = (np.bincount(cell, minlength=cells) > 0).reshape(-1, N2)
        total = total.reshape(-1, N2)
        owner = np.repeat(np.arange(len(count)), n1)
        group = np.arange(len(owner)) - (base // N2)[owner]
        for which, members in enumerate(_SUBSETS):
            sig = mix((group * len(_SUBSETS) + which).astype(np.uint64) * _COEF[0] + scheme[owner].astype(np.uint64) * _COEF[1])
            for m in members:
                sig = mix(sig + total[:, m])
            sigs.append(sig)
            owners.append(owner)
            tags.append(filled[:, members].any(1))
        own = slice(-len(_SUBSETS), None)
        signed = np.concatenate(tags[own])
        whose = np.concatenate(owners[own])
        bound = sure - np.bincount(whose[~signed], minlength=len(count))
        everything = bound < COMMON
        tag = np.where(everything, 0, bound - COMMON) * 2 + step
        take = signed | everything[whose]
        sigs[own], owners[own], tags[own] = [np.concatenate(sigs[own])[take]], [whose[take]], [tag[whose[take]]]
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs).view(np.int64), np.concatenate(owners), np.concatenate(tags).astype(np.int64)


def _word_sets(docs: DataFrame, width: int, ids: list[str], text_col: str) -> DataFrame:
    """The columns ids, n_shingles, set_key (16 bytes; null for the empty set) of every row."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(len(ids))):
                doc, value, count = shingle_sets(texts, width)
                keys = _binary(set_keys(doc, value, count), count == 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(texts)) for k in range(len(ids))), pa.array(count.astype(np.int64)), keys], [*ids, "n_shingles", "set_key"])

    return docs.select(*ids, text_col).mapInArrow(run, ", ".join([*kinds, "n_shingles bigint", "set_key binary"]))


def _new_sets(batches: Iterator[pa.RecordBatch], width: int, wanted=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, shingle, count, keys) of slices of texts; count is 0 for the sets that the task remembers, or wanted(keys) refuses."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            doc, value, count = shingle_sets(texts, width)
            keys = set_keys(doc, value, count)
            new = np.zeros(len(keys), bool)
            asked = count > 0 if wanted is None else (count > 0) & wanted(keys[:, 0])
            for i in np.flatnonzero(asked).tolist():
                key = (int(keys[i, 0]), int(keys[i, 1]))
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            if len(seen) > 500_000:
                seen.clear()
            keep = new[doc]
            yield doc[keep], value[keep], np.where(new, count, 0), keys


#: Salts of a hot signature; the low bits of the tag hold the salt, 0 for signatures that aren't salted.
SALTS = 64


def _signed(docs: DataFrame, width: int, bands: Bands, text_col: str, hot: np.ndarray) -> DataFrame:
    """(sig, key, tag) of the distinct sets; a task signs a set once, as far as it remembers. Signatures in hot (sorted) are salted."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_SIGS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for doc, value, count, keys in _new_sets(batches, width):
            sig, owner, tag = signatures(doc, value, count, bands)
            if len(sig):
                key = keys[owner, 0]
                salt = np.zeros(len(sig), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, sig), len(known) - 1)
                    salt = np.where(known[at] == sig, 1 + (mix(key) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key.view(np.int64)), pa.array((tag * 2 * SALTS + salt).astype(np.int32))], ["sig", "key", "tag"])

    return docs.select(text_col).mapInArrow(run, "sig bigint, key bigint, tag int")


#: Share of the rows in the sample that tells hot signatures, and how many may be told.
SAMPLE, HOT_SIGS = 1 / 64, 20_000


def _hot_signatures(docs: DataFrame, width: int, bands: Bands, text_col: str) -> np.ndarray:
    """Signatures that so many sets of a sample have that at most HOT_SIGS can. What is missed or told in vain changes who
    reads a signature's rows, not what is found."""
    sample = staged(_signed(docs.sample(SAMPLE, 5), width, bands, text_col, np.zeros(0, np.int64)).select("sig", "key").distinct(), "sample")
    least = max(32, -(-sample.count() // HOT_SIGS))
    got = sample.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("sig").toArrow()
    unstage(sample)
    return np.sort(got.column("sig").to_numpy())


def _met(signed: DataFrame) -> DataFrame:
    """(a, b, tag) from signed rows: for signatures of up to HOT sets each pair of their sets (a > b; tag null), for hot and salted
    ones each row (a: the signature, b: the set). Rows of a signature pass one task in order and aren't held."""
    dealt = signed.repartition("sig", F.col("tag") % (2 * SALTS)).sortWithinPartitions("sig")

    def whole(sig: np.ndarray, key: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), pa.array(tag.astype(np.int32))], ["a", "b", "tag"])

    def told(sig: np.ndarray, key: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups; equal keys within one, from tasks that signed the same set, count once. Signatures of one set tell nothing."""
        edge = np.ones(len(sig) + 1, bool)
        edge[1:-1] = sig[1:] != sig[:-1]
        shared = ~(edge[:-1] & edge[1:])
        sig, key, tag = sig[shared], key[shared], tag[shared]
        order = np.lexsort((key, sig))
        sig, key, tag = sig[order], key[order], tag[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, tag = sig[new], key[new], tag[new]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        many = np.repeat(size > HOT, size)
        if many.any():
            yield whole(sig[many], key[many], tag[many])
        few = np.repeat((size > 1) & (size <= HOT), size)
        sig, key = sig[few], key[few]
        left, right = [], []
        for d in range(1, HOT):
            same = np.flatnonzero(sig[d:] == sig[:-d]) if len(sig) > d else np.zeros(0, np.int64)
            if not len(same):
                break
            left.append(key[same + d])
            right.append(key[same])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())], ["a", "b", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_hot = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            # salted signatures, and what goes on with the hot group that the last batch ended in
            at_once = new[2] % (2 * SALTS) > 0
            if open_hot is not None:
                at_once |= new[0] == open_hot
            if at_once.any():
                yield whole(*(x[at_once] for x in new))
                new = [x[~at_once] for x in new]
            if not len(new[0]):
                continue
            open_hot = None
            held = [np.concatenate([h, x]) for h, x in zip(held, new)]
            last = held[0] == held[0][-1]
            yield from told(*(x[~last] for x in held))
            held = [x[last] for x in held]
            if len(held[0]) > HOT and len(np.unique(held[1])) > HOT:
                open_hot = held[0][0]
                yield from told(*held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from told(*held)

    return dealt.mapInArrow(run, "a bigint, b bigint, tag int")


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each key(key) in wanted, by its low bits; sized by their number, 2 to 32 MB. A fuller one lets more pass, none is lost."""
    size = 1 << min(28, max(14, (8 * wanted.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(size - 1))
    words = wanted.select(F.shiftright(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bits


def _elements(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """(key, set_key, elements as sorted 64-bit integers in bytes) of the sets in wanted(key), and of a few more."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.view(np.uint64)

        def asked(key: np.ndarray) -> np.ndarray:
            slot = key & np.uint64(len(own) * 64 - 1)
            return (own[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        for doc, value, count, keys in _new_sets(batches, width, asked):
            at = np.flatnonzero(count > 0)
            if len(at):
                ends = np.cumsum(count)
                cells = pa.array([value[ends[i] - count[i] : ends[i]].tobytes() for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0].copy().view(np.int64)), _binary(keys[at]), cells], ["key", "set_key", "elements"])

    return docs.select(text_col).mapInArrow(run, "key bigint, set_key binary, elements binary")


#: Elements of a block: of two blocks at most are the sets that one comparison holds.
BLOCK = 1 << 21


def _links(keys: list[bytes], parts: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Edges that connect what is similar between the sets at `left` and at `right`: a forest, no more edges than sets.

    Elements are ranked by rising frequency; similar sets share one of their first size - ceil(size num / den) + 1, so
    only those are indexed. Pairs that are connected already aren't compared.
    """
    size = np.array([len(x) for x in parts])
    _, element, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    times = np.sort(times, kind="stable")
    sets = [np.sort(x) for x in np.split(rank[element], np.cumsum(size)[:-1])]
    firsts = [x[: len(x) - -(-num * len(x) // den) + 1] for x in sets]
    firsts = [x[times[x] > 1] for x in firsts]
    place, owner = np.concatenate([firsts[j] for j in right]), np.repeat(right, [len(firsts[j]) for j in right])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    root, out, same = np.arange(len(parts)), [], left is right
    for i in left.tolist():
        begin, end = np.searchsorted(place, firsts[i]), np.searchsorted(place, firsts[i], "right")
        if not (end > begin).any():
            continue
        near = np.unique(np.concatenate([owner[a:b] for a, b in zip(begin, end)]))
        near = near[(den * np.minimum(size[near], size[i]) >= num * np.maximum(size[near], size[i])) & (near != i)]
        near = near[near < i] if same else near
        while len(near := near[root[near] != root[i]]):
            j = int(near[0])
            near = near[1:]
            x, y = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if den * common >= num * (size[i] + size[j] - common):
                root[root == root[j]] = root[i]
                out.append((keys[i], keys[j]))
    return out


def _in_blocks(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """clusters(key, cluster) with blocks: how many a cluster is cut into, by sizes(key, n_shingles) of its sets. Sizes are summed
    before they meet; what is told of the few large clusters goes to SALTS places, over which a large cluster's rows are spread."""
    total = clusters.join(sizes, "key").groupBy("cluster").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > BLOCK)
    large = total.select("cluster", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(large, ["cluster", "salt"], "left").select("key", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))


def _linked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of sets(cluster, blocks, set_key, elements): a spanning forest of all similar pairs within clusters.

    A cluster of more than BLOCK elements is cut into blocks by a hash of the key, and each pair of blocks is compared by
    itself; so pairs are neither rows of a table nor held at once, and a group of any size is spread over tasks.
    """
    cut = sets.withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_key", "elements")
    sorted_ = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "set_key")

    def compare(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        own = np.array([r[3] for r in rows])
        everyone, i, j = np.arange(len(rows)), rows[0][1], rows[0][2]
        left, right = (everyone, everyone) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        return _links([r[4] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], left, right, num, den) if len(left) and len(right) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if held and row[:3] != held[0][:3]:
                    out += compare(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])
                out = []
        if out := compare(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

    return sorted_.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b), of any type that has an order: the smallest node of each connected component.

    Alternates large and small star steps over staged edges until nothing moves; the edges of hubs stay where they are, and what they need
    is broadcast to them.
    """

    def step(df: DataFrame) -> tuple[DataFrame, dict]:
        """df staged, and what tells whether it differs from what another step staged."""
        told = Observation()
        out = staged(df.observe(told, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")), "edges")
        return out, told.get

    now, state = step(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state["n"]:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = _join_rows(both, low, "u", "degree", 2 * state["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        paired = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        hops = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after, moved = step(paired.select(F.explode(hops).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        unstage(now)
        now, settled, state = after, moved == state, moved
        if settled:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _join_rows(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with keyed(key, n, ...), whose keys are unique and which tells by n how many rows have them. Keys with more than
    total / HOT_KEYS rows, HOT_KEYS at most, are broadcast, so no task gets the rows of a hot key."""
    hot = F.col(n) > max(1, total // HOT_KEYS)
    few = F.broadcast(keyed.where(hot))
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(few, key).unionByName(rest)


def _placed(docs: DataFrame, width: int, num: int, den: int, ids: list[str], text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Every row's ids, n_shingles and set_key (null for the empty set); every set's set_key, n (its rows), component (the smallest
    set_key reachable by links) and first (the smallest struct of isnull, ids among the component's rows, then set_key); and the
    number of rows."""
    bands = Bands(num, den)
    rows = staged(_word_sets(docs, width, ids, text_col), "sets")
    first = F.min(F.struct(F.col(f"`{ids[0]}`").isNull().alias("none"), *(F.col(f"`{c}`") for c in ids), "set_key")).alias("first")
    each = staged(rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.count(F.lit(1)).alias("n"), first, F.first("n_shingles").alias("n_shingles")), "each")
    met = staged(_met(_signed(docs, width, bands, text_col, _hot_signatures(docs, width, bands, text_col))), "shared")
    # where a signature isn't hot its sets are few: pairs of them are counted
    often = met.where("tag IS NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("a", "b")
    # a set with too many hot signatures may share too few others with a partner, which then has too many as well
    hot = met.where("tag IS NOT NULL").select(F.col("a").alias("sig"), F.col("b").alias("key"), (F.col("tag") / (2 * SALTS)).cast("int").alias("tag"), (F.col("tag") % (2 * SALTS)).alias("salt")).distinct()
    full = hot.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("h")).where(F.col("h") > F.shiftright("tag", 1)).select("key").distinct()
    tied = hot.join(full, "key", "left_semi").select("sig", "salt", "key").distinct()
    pivots = tied.groupBy("sig", "salt").agg(F.min("key").alias("pivot"))
    stars = tied.join(pivots, ["sig", "salt"]).select("key", "pivot").unionByName(pivots.join(pivots.groupBy("sig").agg(F.min("pivot").alias("top")), "sig").select(F.col("pivot").alias("key"), F.col("top").alias("pivot")))
    stars = often.unionByName(stars.where("key <> pivot").distinct().toDF("a", "b"))
    # what these connect are clusters; links are within them
    found = components(stars)
    sizes = each.select(_low_half(F.col("set_key")).alias("key"), "n_shingles")
    clusters = staged(_in_blocks(found.toDF("key", "cluster"), sizes), "clusters")
    sets = _elements(docs, clusters, width, text_col).join(clusters, "key").dropDuplicates(["key", "set_key"])
    linked = components(_linked(sets, num, den))
    own = each.join(linked.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    own = staged(own, "placed")
    smallest = staged(own.groupBy("component").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_sets")), "smallest")
    unstage(met, clusters, each)
    total = rows.count()
    return rows, _join_rows(own.drop("first"), smallest, "component", "n_sets", own.count()), total


def _low_half(set_key: Column) -> Column:
    """The first 8 bytes of a 16-byte key, little-endian, as the integer that the signatures' rows have."""
    turned = F.concat(*(F.substring(F.hex(set_key), 2 * k + 1, 2) for k in range(7, -1, -1)))
    high = F.conv(F.substring(turned, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(turned, 9, 8), 16, 10).cast("long")
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links) of every row.

    Links hold where den * |a & b| >= num * |a | b| for the sets of width-word shingles. A null or blank text has no
    shingle and no link: component_id is its own id. Rows stay one to one; rows that repeat an id or a text, or
    have a null id, keep their own row, and a null id is never the smallest unless there is none else. Shingles are held as 64-bit
    hashes. Ids may have any type that has an order; other columns aren't read. An empty table gives an empty one.
    """
    rows, sets, total = _placed(docs, width, num, den, [id_col], text_col)
    empty = rows.where("set_key IS NULL").select(id_col, "n_shingles", F.col(f"`{id_col}`").alias("component_id"))
    full = _join_rows(rows.where("set_key IS NOT NULL"), sets.select("set_key", "n", F.col("first").getField(id_col).alias("component_id")), "set_key", "n", total)
    return full.select(id_col, "n_shingles", "component_id").unionByName(empty)


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of links: that of the smallest id, then text. All columns stay.

    A row goes only if its own component has a survivor, so rows that share an id but not a component stay; of rows equal in
    id and text, one stays. Null and blank texts are linked with nothing. Rows without an id can't be named by one and stay as they are.
    """
    own = "jaccard_text_key"
    keyed = docs.withColumn(own, F.xxhash64(text_col))
    rows, sets, _ = _placed(keyed, width, num, den, [id_col, own], text_col)
    first = sets.select("first").distinct()
    kept = first.select(f"first.{id_col}", f"first.{own}").unionByName(rows.where("set_key IS NULL").select(id_col, own)).distinct()
    named = keyed.join(kept, [id_col, own], "left_semi").dropDuplicates([id_col, own]).select(docs.columns)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
