"""Operator 3: near-duplicates by SimHash in an LSH forest.

Every text gets a 128-bit SimHash of its distinct word 5-grams.  Each trie of the
forest orders the signatures by their bits in its own random order, so texts below
a node share a prefix of permuted bits.  The depth follows the density: the
forest starts where nodes hold about ``LEAF`` texts, and ``plan`` adds tries, or
climbs to shorter prefixes where there are few texts, until pairs of the wanted similarity
meet with the target probability in at least one trie.  Nodes that are still
crowded go down further bits; their texts climb: they go through further rounds with shorter prefixes and
larger nodes, until a round splits none of them.  Texts below a node are compared by Hamming
distance (in further rounds also by that of a signature of 4,096 bits, which a crowd
of texts with one template needs), and what is near enough is verified on the exact sets of 5-grams.

Exact copies are one node of the link graph from the start.  A text offers its
nearest ``QUOTA`` partners in a node first.  A pair is left out only if both texts had
more, so further rounds with larger quotas take those texts alone, and offer pairs that the
verified links haven't joined yet: a crowd of copies costs about QUOTA pairs a text and
no link is given up for it.

Defined results: texts of fewer than five words are near-duplicates of exact copies
only; null text counts as empty; rows with null doc_id have null class; texts that
share their smallest doc_id count as linked (repeated ids); the class id is the
smallest doc_id in the class; extra columns are not looked at; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, comb, exp, lgamma, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, digests, expand, in_sorted, mix, slices, squeeze, text_bytes, texts_of, window_hashes, word_digests, word_spans
from .common import written as lasting
from .components import components

SHINGLE, SIMILARITY, BITS = 5, 0.8, 128
#: Bits of the longer signature that offers are sifted by before their sets are fetched; share of missed pairs that the sift may add.
LONG, SIFTED = 1024, 0.02
#: Sets up to this size have tries and distances of their own.
SMALL = 64
#: Texts below a node, about; most below one after going down; most in a task; most ids that are broadcast; first offers of a text in a node.
LEAF, CROWD, TASK, BROADCAST_IDS, QUOTA = 512, 2048, 100_000, 200_000, 16
#: Times that nodes and quotas grow from round to round; bits of the signature that texts of further rounds bring along.
CLIMB, WIDE = 64, 4096
#: Bits of a label.
LABEL = 50
#: Texts of a node that are compared a few rows at a time.
LARGE = 2000
#: Texts of a component of candidate pairs whose sets are compared in one task.
TOGETHER = 2000
TARGET = 0.995
SKETCH = "doc_id long, h0 long, h1 long, s0 long, s1 long, n int"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of word windows of each text, sorted within it, and their offsets (n + 1)."""
    raw, off = text_bytes(texts)
    starts, ends, first = word_spans(raw, off)
    every = window_hashes(word_digests(raw, starts, ends)[:, 0], size)
    n = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    h = every[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[owner]]
    end = np.cumsum(n)
    for x, y in zip((end - n).tolist(), end.tolist(), strict=True):
        h[x:y].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def simhash(hashes: np.ndarray, off: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(n, bits / 64) uint64 signatures: bit by bit what most hashes of a set have."""
    n = len(off) - 1
    out = np.zeros((n, bits // 64), dtype=np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        seeds = mix(np.arange(0x2545F491, 0x2545F491 + bits // 64, dtype=np.uint64))
        words = np.stack([mix(hashes ^ x) for x in seeds], axis=1)
        lanes = np.unpackbits(words.view(np.uint8), axis=1).view(np.uint64)  # eight counters of a byte in a word
        runs = -(-np.diff(off)[some] // 255)  # no byte overflows within 255 rows
        at = np.cumsum(runs) - runs
        heads = np.repeat(off[some], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(at, runs))
        ones = np.add.reduceat(np.add.reduceat(lanes, heads, axis=0).view(np.uint8), at, axis=0, dtype=np.int32)
        out[some] = np.ascontiguousarray(np.packbits(2 * ones > np.diff(off)[some][:, None], axis=1)).view(np.uint64)
    return out


def text_digests(texts: pa.Array) -> np.ndarray:
    """(n, 2) digests of whole texts; null is empty."""
    return np.ascontiguousarray(digests((x or "").encode() for x in texts.to_pylist()).T).T


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=1 << 20):
        one, two = text_digests(b.column(1)).T
        hashes, cut = shingle_sets(b.column(1))
        s = simhash(hashes, cut)
        cols = [b.column(0), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (one, two, s[:, 0], s[:, 1])), pa.array(np.diff(cut).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h0", "h1", "s0", "s1", "n"])


@dataclass(frozen=True)
class Forest:
    """tries, depth of the nodes that are compared, and the Hamming distance up to which pairs are verified; the tries and distances by size of set.

    ``of_size[n]`` holds for a set of n, the last one for all over ``SMALL``; ``tries`` and ``distance`` are the largest of them.
    """

    tries: int
    depth: int
    distance: int
    of_size: np.ndarray

    def by_size(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tries and distances of sets of the given sizes."""
        own = self.of_size[np.minimum(n, SMALL + 1)]
        return own[:, 0], own[:, 1]


def differing(n: int, m: int, similarity: float) -> float:
    """The exact chance that a bit differs between sets of n and m that have just enough in common.

    Most of a set decides, and ties are 0: it depends on the sizes, most of all if one is even and one odd.
    """
    both = ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
    if both > min(n, m):
        return 0.0
    x = np.arange(both + 1)

    def one(size: int) -> np.ndarray:
        """The chance of a 1 if x of the common hashes have it."""
        rest = size - both
        tail = np.append(np.cumsum([comb(rest, k) / 2**rest for k in range(rest, -1, -1)])[::-1], 0)
        return tail[np.clip(size // 2 + 1 - x, 0, rest + 1)]

    p, q = one(n), one(m)
    return float(np.dot([comb(both, k) / 2**both for k in x.tolist()], p * (1 - q) + q * (1 - p)))


@cache
def chances_by_size(similarity: float) -> np.ndarray:
    """For sets of each size up to ``SMALL``, and last for all larger ones: the highest chance that a bit differs from one that is similar enough.

    The chance falls towards that of large sets, acos(2s / (1 + s)) / pi, in waves; the sizes just over ``SMALL`` have the highest of the rest.
    """
    worst = [0.0]
    for n in range(1, 2 * SMALL + 1):
        worst.append(max((differing(n, m, similarity) for m in range(ceil(similarity * n - 1e-9), int(n / similarity + 1e-9) + 1)), default=0.0))
    limit = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return np.array([*worst[: SMALL + 1], max(limit, *worst[SMALL + 1 :])])


def distances(differ: float, bits: int) -> np.ndarray:
    """Chances of each Hamming distance between signatures whose bits differ with the given chance."""
    if differ <= 0:
        return np.eye(1, bits + 1)[0]
    return np.array([exp(lgamma(bits + 1) - lgamma(h + 1) - lgamma(bits - h + 1) + h * log(differ) + (bits - h) * log(1 - differ)) for h in range(bits + 1)])


def farthest(differ: float, bits: int, missed: float) -> int:
    """The Hamming distance that at most a share of ``missed`` pairs exceeds."""
    return int(np.searchsorted(np.cumsum(distances(differ, bits)), 1 - missed))


def sift_limits(similarity: float, bits: int = LONG) -> np.ndarray:
    """Up to how many bits of a longer signature may differ, by size of set as in ``chances_by_size``."""
    return np.array([farthest(x, bits, (1 - TARGET) * SIFTED) for x in chances_by_size(similarity)])


def plan(n: int, similarity: float = SIMILARITY, target: float = TARGET, leaf: int = LEAF) -> Forest:
    """Depth by density, and tries until pairs at ``similarity`` meet with probability ``target``, for each size of set.

    Large sets with Jaccard similarity s have a cosine of 2s / (1 + s) at equal sizes (more
    otherwise), so a bit differs with probability acos(cosine) / pi; small ones differ in more.
    """
    depth = max(0, min(48, int(log2(max(n, 1) / leaf)))) if n > leaf else 0
    need = target + (1 - target) * SIFTED
    known: dict[float, tuple[int, int]] = {}
    for differ in np.unique(chances_by_size(similarity)).tolist():
        chance = distances(differ, BITS)
        distance = farthest(differ, BITS, (1 - target) / 10)
        share = np.array([comb(BITS - h, depth) / comb(BITS, depth) for h in range(distance + 1)])
        tries = 1
        while float((chance[: distance + 1] * (1 - (1 - share) ** tries)).sum()) < need:
            tries += max(1, tries // 16)
        known[differ] = tries, distance
    of_size = np.array([known[x] for x in chances_by_size(similarity).tolist()])
    return Forest(int(of_size[:, 0].max()), depth, int(of_size[:, 1].max()), of_size)


def order_of_bits(trie: int) -> np.ndarray:
    return np.random.default_rng([trie, BITS]).permutation(BITS)[:64]


def labels(s: np.ndarray, trie: int) -> np.ndarray:
    """The first ``LABEL`` permuted bits of each signature, most significant first, as a number."""
    bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8), axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, order_of_bits(trie)], axis=1)).view(">u8")[:, 0].astype(np.uint64) >> U64(64 - LABEL)


def nodes(label: np.ndarray, depth: int, group: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the nodes of sorted labels begin (and the end), and which rows were in a node that was split.

    Nodes have ``depth`` bits, more where over ``crowd`` rows of several classes share them.
    """
    deep = np.full(len(label), depth, dtype=np.uint64)
    while True:
        key = label >> (U64(LABEL) - deep)
        new = np.ones(len(label), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (deep[1:] != deep[:-1])
        heads = np.append(np.flatnonzero(new), len(label))
        sizes = np.diff(heads)
        crowded = np.repeat((sizes > crowd) & ~_one_class(group, heads), sizes) & (deep < LABEL)
        if not crowded.any():
            return heads, deep > depth
        deep[crowded] += U64(1)


def _one_class(group: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which nodes hold one class only."""
    if len(heads) < 2:
        return np.zeros(0, dtype=bool)
    held = group[: heads[-1]]
    return np.maximum.reduceat(held, heads[:-1]) == np.minimum.reduceat(held, heads[:-1])


class Wide:
    """The longer signatures of rows, and how many of their bits may differ."""

    def __init__(self, blobs: list[bytes], n: np.ndarray, limits: np.ndarray) -> None:
        self.bits = np.frombuffer(b"".join(blobs), dtype=np.uint64).reshape(len(blobs), WIDE // 64)
        self.most = limits[np.minimum(n, SMALL + 1)]

    def sifted(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs that are near enough by these too, and that distance."""
        parts = []
        part = 1 + self.bits.shape[1] // 4
        for x in range(0, len(i), 1 << 15):  # a part of the bits rules out most
            p, q = i[x : x + (1 << 15)], j[x : x + (1 << 15)]
            most = np.minimum(self.most[p], self.most[q])
            some = np.bitwise_count(self.bits[p, :part] ^ self.bits[q, :part]).sum(axis=1, dtype=np.int64)
            left = some <= most
            p, q, most, some = p[left], q[left], most[left], some[left]
            some += np.bitwise_count(self.bits[p, part:] ^ self.bits[q, part:]).sum(axis=1, dtype=np.int64)
            left = some <= most
            parts.append((p[left], q[left], some[left]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (i, j, d.astype(np.int64))


def _near(s: np.ndarray, n: np.ndarray, group: np.ndarray, lo: int, hi: int, end: np.ndarray, distance: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Pairs among rows lo..hi whose nodes end at ``end``, from different classes and near enough: i, j, distance."""
    found = []
    at, k = np.arange(lo, hi), 0
    while True:
        k += 1
        at = at[at + k < end[at]]
        if not len(at):
            break
        d = np.bitwise_count(s[at, 0] ^ s[at + k, 0]) + np.bitwise_count(s[at, 1] ^ s[at + k, 1])
        hit = np.flatnonzero(d <= distance[at])
        i, j = at[hit], at[hit] + k
        ok = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        found.append((i[ok], j[ok], d[hit][ok]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def _beside(s: np.ndarray, n: np.ndarray, group: np.ndarray, rows: tuple[int, int], among: tuple[int, int], distance: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Pairs of the given rows with all rows of a larger part of their node, both ways round: i, j, distance."""
    (lo, hi), (x, z) = rows, among
    d = np.bitwise_count(s[lo:hi, 0][:, None] ^ s[x:z, 0]) + np.bitwise_count(s[lo:hi, 1][:, None] ^ s[x:z, 1])
    i, j = np.nonzero(d <= distance[lo:hi, None])
    d = d[i, j]
    i, j = i + lo, j + x
    ok = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
    return i[ok], j[ok], d[ok]


def _rank(owner: np.ndarray, far: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner, nearest pairs first, and the rank of each in it."""
    order = np.lexsort((pair, far, owner))
    first = np.ones(len(order), dtype=bool)
    first[1:] = owner[order][1:] != owner[order][:-1]
    return order, np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]


def offers(ids: np.ndarray, s: np.ndarray, n: np.ndarray, group: np.ndarray, heads: np.ndarray, split: np.ndarray, distance: np.ndarray, quota: int, crowd: int, similarity: float, wide: Wide | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (a, b) that are offered for verification, and whether a and b may have more partners than that.

    ``split`` rows were in a node that went down further bits: what they share it with may be in another part
    of it.  They are left (as pairs of a text with itself) to the next round, which splits larger
    nodes only.  Nodes stay larger than ``crowd`` only where all bits of the label agree: their rows are compared with
    the ones up to ``crowd`` rows away, which links what is alike in a chain, and left to the next round too.
    """
    sizes = np.diff(heads)
    alone = _one_class(group, heads)
    end = np.repeat(np.where(alone, 0, heads[1:]), sizes)
    again = split[: heads[-1]].copy()
    again[np.repeat((sizes > crowd) & ~alone, sizes)] = True
    work = np.cumsum(sizes.astype(np.int64) ** 2)
    large = np.append(np.flatnonzero(sizes > LARGE), len(sizes))

    def ordered(i: np.ndarray, j: np.ndarray, more_i: np.ndarray, more_j: np.ndarray) -> tuple[np.ndarray, ...]:
        swap = ids[i] > ids[j]
        return np.where(swap, ids[j], ids[i]), np.where(swap, ids[i], ids[j]), np.where(swap, more_j, more_i), np.where(swap, more_i, more_j)

    start = 0
    while start < len(sizes):
        if sizes[start] > LARGE:  # a few rows at a time
            lo, z = int(heads[start]), 0 if alone[start] else int(heads[start + 1])
            x = lo
            while lo < z:
                part = (max(x, lo - crowd), min(z, lo + 2 * crowd)) if z - x > crowd else (x, z)
                hi = min(z, lo + max(1, min(crowd, 1_000_000 // (part[1] - part[0]))))
                i, j, d = _beside(s, n, group, (lo, hi), part, distance, similarity)
                if wide:
                    i, j, d = wide.sifted(i, j, d)
                order, rank = _rank(i, d, j)
                again[i[order[rank >= quota]]] = True
                i, j = i[order[rank < quota]], j[order[rank < quota]]
                new = (i < j) | (j < part[0]) | again[j]  # the others have been offered by j's own rows
                none = np.zeros(int(new.sum()), dtype=bool)
                if len(none):
                    yield ordered(i[new], j[new], none, none)
                lo = hi
            start += 1
            continue
        # a few nodes at a time, so that their pairs fit into memory
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + 4_000_000, side="right")))
        stop = min(stop, int(large[np.searchsorted(large, start)]))
        i, j, d = _near(s, n, group, int(heads[start]), int(heads[stop]), end, distance, similarity)
        start = stop
        if wide:
            i, j, d = wide.sifted(i, j, d)
        if not len(i):
            continue
        owner, pair, far = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2), np.tile(d, 2)
        order, rank = _rank(owner, far, pair)
        taken = np.zeros(len(i), dtype=bool)
        taken[pair[order[rank < quota]]] = True
        over = np.zeros(len(ids), dtype=bool)
        over[owner[order[rank >= quota]]] = True
        i, j = i[taken], j[taken]
        yield ordered(i, j, over[i], over[j])
    if again.any():
        left = ids[: heads[-1]][again]
        yield left, left, np.ones(len(left), bool), np.ones(len(left), bool)


def candidates(texts: DataFrame, forest: Forest, quota: int, crowd: int, similarity: float) -> DataFrame:
    """Distinct offers (a, b, more_a, more_b) over all tries for (id, s0, s1, n), in further rounds with (class_id, wide) too."""

    later = "wide" in texts.columns
    kinds = "id long, s0 long, s1 long, n int" + ", class_id long, wide binary" * later
    limits = sift_limits(similarity, WIDE) if later else None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.stack([b.column(k).to_numpy() for k in (1, 2)], axis=1).view(np.uint64)
            tries = forest.by_size(b.column(3).to_numpy())[0]
            for trie in range(forest.tries):
                take = np.flatnonzero(tries > trie)
                if len(take):
                    key = pa.array((labels(s[take], trie) | U64(trie << LABEL)).view(np.int64))
                    rows = b.take(pa.array(take)) if len(take) < b.num_rows else b
                    yield pa.RecordBatch.from_arrays([key, *rows.columns], ["key", *rows.schema.names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def run(last: bool) -> Iterator[pa.RecordBatch]:
            """Compare all nodes that are complete; the last one stays."""
            nonlocal held
            key, ids, s0, s1, n = held[:5]
            group = held[5] if later else ids
            trie, label = key >> LABEL, key & ((1 << LABEL) - 1)
            cut = np.flatnonzero(np.diff(trie)) + 1
            parts = [(a, nodes(label[a:z].view(np.uint64), forest.depth, group[a:z], crowd)) for a, z in zip([0, *cut], [*cut, len(trie)], strict=True)]
            if not last:  # the whole node of ``depth`` bits stays: what follows decides whether it is split
                bits = key >> (LABEL - forest.depth)
                stays = int(np.flatnonzero(bits != bits[-1])[-1]) + 1 if bits[0] != bits[-1] else 0
            else:
                stays = len(trie)
            heads = np.concatenate([a + h[:-1] for a, (h, _) in parts])
            heads = np.append(heads[heads < stays], stays).astype(np.int64)
            split = np.concatenate([x for _, (_, x) in parts])
            wide = Wide(held[6][:stays].tolist(), n[:stays], limits) if later else None
            held = [x[stays:] for x in held]
            if stays:
                for done in offers(ids, np.stack([s0, s1], axis=1).view(np.uint64), n, group, heads, split, forest.by_size(n)[1], quota, crowd, similarity, wide):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["a", "b", "more_a", "more_b"])

        most = TASK
        for b in batches:
            fresh = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = [np.concatenate(x) for x in zip(held, fresh, strict=True)] if held else fresh
            if len(held[0]) >= most:
                yield from run(False)
                most = max(TASK, 2 * len(held[0]))
        if held and len(held[0]):
            yield from run(True)

    names = [x.split()[0] for x in kinds.split(", ")]
    rows = texts.select(*names).mapInArrow(spread, "key long, " + kinds)
    parted = rows.repartition(F.shiftright("key", LABEL - forest.depth)).sortWithinPartitions("key", "id")
    return parted.mapInArrow(compare, "a long, b long, more_a boolean, more_b boolean").groupBy("a", "b").agg(F.max("more_a").alias("more_a"), F.max("more_b").alias("more_b"))


def sets_and_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grams, sign) of (doc_id, text): the set of word 5-grams, and its size and a longer signature."""
    for b in slices(batches, most=1 << 18):
        h, off = shingle_sets(b.column(1))
        blobs = [squeeze(h[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
        longer = [x.tobytes() for x in np.concatenate([np.diff(off).astype(np.uint64)[:, None], simhash(h, off, LONG)], axis=1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary()), pa.array(longer, pa.binary())], ["id", "grams", "sign"])


def wide_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h0, wide) of (doc_id, text): the signature of further rounds."""
    for b in slices(batches, most=1 << 16):
        h0 = text_digests(b.column(1))[:, 0].view(np.int64)
        wide = simhash(*shingle_sets(b.column(1)), WIDE)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h0), pa.array([x.tobytes() for x in wide], pa.binary())], ["id", "h0", "wide"])


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    both = int(in_sorted(p, q).sum())
    return both > 0 and both >= similarity * (len(p) + len(q) - both) - 1e-9


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with one of the distinct ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets of word 5-grams are similar enough, by exact intersection.

    A longer signature sifts the pairs first, by limits that follow from the sizes of the sets.  What is left falls into components; the sets
    of one of up to ``TOGETHER`` texts are sent to one task once, and all its pairs are
    verified there.  Pairs of larger components fetch their sets pair by pair.
    """
    grams = scratch.written(with_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()).mapInArrow(sets_and_signs, "id long, grams binary, sign binary"), "grams")
    limits = sift_limits(similarity)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(-1, 1 + LONG // 64) for c in b.columns[2:])
                most = limits[np.minimum(np.minimum(x[:, 0], y[:, 0]), U64(SMALL + 1)).astype(np.int64)]
                near = np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64) <= most
                yield b.select(["a", "b"]).filter(pa.array(near))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)) if alike(expand(x.as_py(), "u8"), expand(y.as_py(), "u8"), similarity)]
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def together(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for i, blob in zip(sets.column("id").to_pylist(), sets.column("grams"), strict=True):
            held.setdefault(i, []).append(expand(blob.as_py(), "u8"))
        a, b = (pairs.column(c).to_pylist() for c in ("a", "b"))
        keep = [k for k in range(len(a)) if any(alike(p, q, similarity) for p in held.get(a[k], ()) for q in held.get(b[k], ()))]
        return pairs.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        x, y = (grams.select(F.col("id").alias(k), F.col(column).alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    near = scratch.written(beside(pairs.select("a", "b"), "sign").mapInArrow(close, "a long, b long").distinct(), "near")
    if not near.limit(1).count():
        return near
    groups = components(near, scratch)
    sizes = groups.groupBy("class_id").agg(F.count("*").alias("size"))
    small = groups.join(sizes.where(F.col("size") <= TOGETHER).select("class_id"), "class_id")
    small = scratch.written(small, "small")
    placed = scratch.written(near.join(small.withColumnRenamed("id", "a"), "a", "left"), "placed")
    sets = grams.select("id", "grams").join(small, "id")
    found = placed.where("class_id IS NOT NULL").groupBy("class_id").cogroup(sets.groupBy("class_id")).applyInArrow(together, "a long, b long")
    rest = placed.where("class_id IS NULL").select("a", "b")
    if rest.limit(1).count():
        found = found.unionByName(beside(rest, "grams").mapInArrow(similar, "a long, b long").distinct())
    return found


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row: rows of one class are linked by exact or near copies."""
    docs = texts_of(df, id_col, text_col)
    scratch = Scratch(df.sparkSession)
    written = scratch.written
    sketches = written(docs.mapInArrow(_sketch, SKETCH), "sketches")
    # Copies of one text meet here: the smallest id stands for them (partial minima come first, so many copies don't gather).
    stand = written(sketches.where("doc_id IS NOT NULL").groupBy("h0", "h1", "s0", "s1", "n").agg(F.min("doc_id").alias("id")), "texts")
    texts = stand.where("n > 0")
    left, scale = texts, 1
    tested = links = wide = None
    while True:
        forest = plan(left.count(), similarity, target, LEAF * scale)
        offered = written(candidates(left, forest, QUOTA * scale, CROWD * scale, similarity), "offers")
        fresh = offered.where("a <> b").select("a", "b") if tested is None else offered.where("a <> b").select("a", "b").join(tested, ["a", "b"], "left_anti")
        found = written(verified(fresh, docs, similarity, scratch), "verified") if fresh.limit(1).count() else fresh
        links = found if links is None else links.unionByName(found)
        tested = fresh if tested is None else tested.unionByName(fresh)
        classes = components(links, scratch)
        crowded = written(offered.where("more_a").select(F.col("a").alias("id")).union(offered.where("more_b").select("b")).distinct(), "crowded")
        if not crowded.limit(1).count():
            break
        scale *= CLIMB
        left = texts.join(crowded, "id", "left_semi").join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        if wide is None:  # the texts of later rounds are among those of this one
            wide = written(with_ids(docs, crowded.select(F.col("id").alias("doc_id"))).mapInArrow(wide_signs, "id long, h0 long, wide binary").dropDuplicates(["id", "h0"]), "wide")
        left = written(left.join(wide, ["id", "h0"]), "left")
    known = sketches.select("doc_id", "h0", "h1").join(stand.select("h0", "h1", F.col("id").alias("own")), ["h0", "h1"], "left")
    own = known.join(classes.withColumnRenamed("id", "own"), "own", "left")
    result = lasting(own.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "own")).alias("class_id")), "classes")
    scratch.drop()
    return result


def one_of_each(df: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each class of texts: the one with the smallest id, null ids last.

    Rows are told apart by numbers of their own, so that repeated and null ids neither keep copies nor link different texts.
    """
    row = "_row"
    while row.lower() in {c.lower() for c in df.columns}:
        row += "_"
    rows = lasting(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows, similarity, target, row, text_col).withColumnRenamed("doc_id", row)
    ids = rows.select(row, F.col(f"`{id_col}`").cast("long").alias("id"))
    kept = classes.join(ids, row).groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).getField(row).alias("kept"))
    gone = lasting(classes.join(kept, "class_id").where(F.col(row) != F.col("kept")).select(row), "copies")
    return rows.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
