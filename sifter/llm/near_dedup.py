"""Near-duplicate detection with BagMinHash signatures of word-shingle multisets.

A text is the multiset of its ``shingle``-word shingles (lower-cased; a shorter text is one
shingle). For every element, Poisson processes stand for the discretised weight levels: one of
rate 1 for the level (0, 1], one of rate 2**k for each block of levels (2**k, 2**(k+1)]; a point of
a block has a level in it, and only points up to the element's multiplicity count. So an element
of weight w costs about log2(w) processes, not w. Each point falls on one of the ``size``
registers, which keeps its earliest point; two texts agree on a register with the chance of their
weighted Jaccard similarity. Points are generated in rising order up to a time by which all
registers are filled, for all texts of a batch at once.

Texts with equal multisets are one class from the start and one representative goes on. Its
registers are banded; in each bucket every member is compared with the bucket's first one, and
the links that hold are joined into components. In every bucket that still holds members of
different components, those outside its largest component are compared with all others of other
components, by exact multisets and in blocks of bounded bytes. A worker joins what it links at
once and returns only links that join two components, less than one a member, never the pairs that
it tried. No bucket is capped, and no link between different texts is lost that any band brings
together (a pair at similarity 0.8 is missed by all bands with chance 3e-6).

Defined cases: texts that are null or without words are in no class with others; a class id is the
smallest id of the class, null where none has one; repeated rows are copies; rows that share an id,
or have none, are told apart by their texts, and each gets the class of its text; very long texts
are taken whole; ties between copies go to the smaller id; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import staged
from sifter.llm.hashing import GOLD as _GOLD
from sifter.llm.hashing import U as _U
from sifter.llm.hashing import mix as _mix
from sifter.llm.hashing import run_hashes, tidied, word_bounds


@dataclass(frozen=True)
class NearDedup:
    """Parameters; the defaults are those of the registered query."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 42
    rows: int = 6
    seed: int = 7
    #: Bytes of text in a block, on average: what a comparison holds twice.
    block_bytes: int = 4 << 20
    #: Members of a star that are compared in one group.
    star: int = 4096

    @property
    def size(self) -> int:
        return self.bands * self.rows


_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


# Shingles


def shingle_batch(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles, with repeats and sorted within a text; shingles by text.

    A shingle's hash is that of its bytes, with one blank for each run of white space.
    """
    kept, sizes = tidied([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    bounds, ends = word_bounds(kept), np.cumsum(sizes)
    word = np.arange(sizes.sum())
    first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    some = (word + n <= last) | (word == first)
    h = run_hashes(kept, bounds[word[some]], bounds[np.minimum(word + n, last)[some]])
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    at = 0
    for c in counts.tolist():
        h[at : at + c].sort()
        at += c
    return h, counts


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's shingles, with repeats."""
    return shingle_batch([text], n)[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


# Signatures


@dataclass(frozen=True)
class _Processes:
    """Poisson processes: the owner's first register, key and horizon; rate, lower level and weight where levels are in blocks."""

    base: np.ndarray
    key: np.ndarray
    horizon: np.ndarray
    rate: np.ndarray | None = None
    low: np.ndarray | None = None
    weight: np.ndarray | None = None


def _run(best: np.ndarray, p: _Processes, at: np.ndarray, many: int, spec: NearDedup) -> None:
    """The points of processes `at` up to their horizons, `many` at a time, into the registers."""
    time, done = np.zeros(len(at)), 0
    while len(at):
        h = _mix(p.key[at][:, None] + (np.arange(done + 1, done + many + 1, dtype=np.uint64) * _GOLD + _U(spec.seed)))
        when = (h >> _U(11)).astype(np.float64)
        when += 0.5
        when *= 2.0**-53
        np.log(when, out=when)
        np.negative(when, out=when)
        if p.rate is not None:
            when /= p.rate[at][:, None]
        when[:, 0] += time
        np.cumsum(when, axis=1, out=when)
        on = when <= p.horizon[at][:, None]
        hit = np.flatnonzero(on)
        row, g = at[hit // many], _mix(h.ravel()[hit] ^ _U(0xD6E8FEB86659FD93))
        slot = p.base[row] + ((g & _U(0xFFFFFFFF)) * _U(spec.size) >> _U(32)).astype(np.int64)
        # The time's bits are in its order, so the least number is the earliest point.
        mark = when.ravel()[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32) | g >> _U(32)
        if p.low is not None:
            level = p.low[row] + 1 + ((g >> _U(32)) & (p.low[row] - 1).astype(np.uint64)).astype(np.int64)
            some = level <= p.weight[row]
            slot, mark = slot[some], mark[some]
        np.minimum.at(best, slot, mark)
        on = on[:, -1]
        at, time, done, many = at[on], when[on, -1], done + many, max(1, many // 2)


def _points(best: np.ndarray, p: _Processes, spec: NearDedup) -> None:
    """All processes, those of like length together and few enough to stay in a core's cache."""
    expected = p.horizon if p.rate is None else p.horizon * p.rate
    scale = np.ceil(np.log2(np.maximum(expected, 1))).astype(np.int64)
    for o in np.unique(scale):
        at, many = np.flatnonzero(scale == o), min(4096, max(1, (3 << int(o)) // 4))
        step = max(1, 32768 // many)
        for k in range(0, len(at), step):
            _run(best, p, at[k : k + step], many, spec)


def signatures(hashes: np.ndarray, counts: np.ndarray, spec: NearDedup) -> np.ndarray:
    """BagMinHash registers, a row a multiset: the fingerprint of each register's first point.

    hashes holds the multisets one after another, each sorted; counts are their sizes.
    """
    size, n = spec.size, len(counts)
    best = np.full(n * size, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), counts)
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    at = np.flatnonzero(new)
    element, owner, weight = hashes[at], owner[at], np.diff(np.append(at, len(hashes)))
    todo, reach = counts > 0, np.log(size) + 4.0
    while todo.any():
        some = todo[owner]
        e, o, w = element[some], owner[some], weight[some]
        horizon = size * reach / counts[o]
        _points(best, _Processes(o * size, _mix(e), horizon), spec)
        k = 0
        while (some := w > 1 << k).any():
            e, o, w, horizon = e[some], o[some], w[some], horizon[some]
            key = _mix(e ^ _mix(np.full(len(e), k + 1, np.uint64)))
            _points(best, _Processes(o * size, key, horizon, np.full(len(e), float(1 << k)), np.full(len(e), 1 << k), w), spec)
            k += 1
        todo &= (best.reshape(n, size) == _EMPTY).any(axis=1)
        reach *= 2  # the few with an empty register go on for longer
        best.reshape(n, size)[todo] = _EMPTY
    return (best & _U(0xFFFFFFFF)).astype(np.uint32).reshape(n, size)


def buckets(marks: np.ndarray, spec: NearDedup) -> np.ndarray:
    """A hash of each band's registers and its number, a row a signature."""
    bands = marks.astype(np.uint64).reshape(-1, spec.bands, spec.rows)
    h = np.full(bands.shape[:2], spec.seed, np.uint64) + np.arange(spec.bands, dtype=np.uint64)
    for r in range(spec.rows):
        h = _mix(h * _GOLD + bands[:, :, r])
    return h.astype(np.int64)


# Components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of links: its component's smallest node.

    Rounds of large-star and small-star joins, each written out, until nothing changes.
    """
    pairs = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_in = large.filter("u > v").distinct()
        least = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(least, "u")
        pairs = staged(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u > v")
            .distinct()
        )
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# The operator

_PART = 256  # texts that are worked on at once


def _same(hashes: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A digest of each multiset; None for an empty one."""
    ends = np.cumsum(counts)
    return [hashlib.blake2b(hashes[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _signed(spec: NearDedup) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                part = batch.slice(at, _PART)
                hashes, counts = shingle_batch(part.column(1).to_pylist(), spec.shingle)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (len(counts) + 1) * spec.bands, spec.bands, dtype=np.int32)), pa.array(buckets(signatures(hashes, counts, spec), spec).ravel())
                )
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_same(hashes, counts), pa.binary()), bands], ["id", "same", "bands"])

    return sign


def _digested(spec: NearDedup) -> Callable:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                part = batch.slice(at, _PART)
                same = _same(*shingle_batch(part.column(1).to_pylist(), spec.shingle))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.binary())], ["id", "text", "same"])

    return digest


def _grouped(keys: list[str], each: Callable[[pa.Table], list[tuple[int, int]]]) -> Callable:
    """A function for mapInArrow that hands whole groups of rows in order of their keys to `each`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        carry: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            if last is not None and last != tuple(c[0] for c in columns):
                yield out(each(pa.Table.from_batches(carry)))
                carry = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                carry.append(batch.slice(a, b - a))
                if k < len(cuts) - 2:
                    yield out(each(pa.Table.from_batches(carry)))
                    carry = []
            last = tuple(c[-1] for c in columns)
        if carry:
            yield out(each(pa.Table.from_batches(carry)))

    return run


class _Sets:
    """The multisets of some texts, as numbers of distinct shingles and their counts."""

    def __init__(self, texts: list[str], spec: NearDedup) -> None:
        hashes, self.sizes = shingle_batch(texts, spec.shingle)
        values, code = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)])
        self.code, self.count = code[at], np.diff(np.append(at, len(code)))
        self.ends = np.cumsum(np.bincount(owner[at], minlength=len(texts)))
        self.held = np.zeros(len(values), np.int64)

    def _span(self, k: int) -> slice:
        return slice(self.ends[k - 1] if k else 0, self.ends[k])

    def alike(self, k: int, others: np.ndarray) -> np.ndarray:
        """Similarities of text k and the others."""
        own = self._span(k)
        self.held[self.code[own]] = self.count[own]
        spans = [self._span(x) for x in others.tolist()]
        starts = np.cumsum([0] + [s.stop - s.start for s in spans[:-1]])
        code = np.concatenate([self.code[s] for s in spans])
        both = np.add.reduceat(np.minimum(np.concatenate([self.count[s] for s in spans]), self.held[code]), starts)
        self.held[self.code[own]] = 0
        return both / (self.sizes[k] + self.sizes[others] - both)


def _joining(t: pa.Table, spec: NearDedup) -> list[tuple[int, int]]:
    """Links between the two blocks of a group (or within its only one) that join components.

    Members outside the largest component meet all of other components; what is linked is joined
    at once, so there are fewer links than members.
    """
    side, ids, roots = (t.column(c).to_numpy() for c in ("side", "id", "root"))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    top = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    if len(top) == 1:
        return []
    sets = _Sets(t.column("text").to_pylist(), spec)
    main = Counter(roots.tolist()).most_common(1)[0][0]
    labels, links = roots.copy(), []
    for k in np.flatnonzero(roots != main).tolist():
        near = (labels != labels[k]) & (np.minimum(sets.sizes, sets.sizes[k]) >= spec.similarity * np.maximum(sets.sizes, sets.sizes[k]))
        if i != j:
            near &= side != side[k]
        at = np.flatnonzero(near)
        if not len(at):
            continue
        for x in at[sets.alike(k, at) >= spec.similarity].tolist():
            a, b = find(int(roots[k])), find(int(roots[x]))
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((int(ids[k]), int(ids[x])))
                labels[(labels == a) | (labels == b)] = min(a, b)
    return links


def _apart(held: DataFrame, roots: DataFrame, texts: DataFrame, spec: NearDedup) -> DataFrame:
    """Links (a, b) that join components which still meet in a bucket."""
    labelled = held.select("bucket", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    labelled = staged(labelled.join(texts.select("id", F.octet_length("text").cast("long").alias("bytes")), "id"))
    # A bucket of two was compared as a star. Buckets with the same members are compared once.
    mixed = (
        labelled.groupBy("bucket")
        .agg(
            F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s0"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s1"),
        )
        .filter("r0 <> r1 and n > 2")
        .groupBy("n", "s0", "s1")
        .agg(F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes"))
    )
    blocks = staged(mixed.select("bucket", F.ceil(F.col("bytes") / spec.block_bytes).cast("int").alias("blocks")))
    rows = labelled.select("bucket", "id", "root").join(blocks, "bucket").withColumn("side", F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1))).cast("int"))
    # A block meets every block, itself included: (i, j) with i <= j.
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1))).select(
        "bucket", "id", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")
    )
    return (
        dealt.join(texts, "id")
        .select("bucket", "i", "j", "side", "id", "root", "text")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "id")
        .mapInArrow(_grouped(["bucket", "i", "j"], lambda t: _joining(t, spec)), "a long, b long")
    )


def _stars(held: DataFrame, texts: DataFrame, spec: NearDedup) -> DataFrame:
    """Links (a, b) between the first member a of a bucket and its others."""
    pairs = held.filter("id <> head").select("head", "id").distinct()
    sized = staged(pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / spec.star).cast("int").alias("parts")))
    dealt = pairs.join(sized, "head").select("head", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    firsts = sized.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("id"))

    def links(t: pa.Table) -> list[tuple[int, int]]:
        ids, head, out = t.column("id").to_numpy(), t.column("head")[0].as_py(), []
        for k in range(1, len(ids), _PART):  # the head comes first; some texts at a time
            sets = _Sets([t.column("text")[0].as_py(), *t.column("text").slice(k, _PART).to_pylist()], spec)
            near = sets.alike(0, np.arange(1, len(sets.sizes))) >= spec.similarity
            out += [(head, int(x)) for x in ids[k : k + _PART][near]]
        return out

    return (
        dealt.unionByName(firsts)
        .join(texts, "id")
        .select("head", "part", "id", "text")
        .repartition("head", "part")
        .sortWithinPartitions("head", "part", F.col("id") != F.col("head"), "id")
        .mapInArrow(_grouped(["head", "part"], links), "a long, b long")
    )


def _labelled(base: DataFrame, spec: NearDedup) -> DataFrame:
    """row, id, root of every row of base (id, text): rows of a class, and no others, share a root.

    A row is a number given to it when its signature is written; a root is the row of its class's
    first text.
    """
    signed = base.mapInArrow(_signed(spec), "id long, same binary, bands array<long>")
    signed = staged(signed.select(F.monotonically_increasing_id().alias("row"), "id", "same", "bands"))
    # Equal multisets, however many: sums by key first, one representative each.
    firsts = staged(signed.filter("same is not null").groupBy("same").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    joined = signed.join(firsts.select("same", "rep"), "same", "left").withColumn("rep", F.coalesce("rep", "row"))
    joined = staged(joined.select("row", "id", "rep", F.when(F.col("row") == F.col("rep"), F.col("same")).alias("same"), F.when(F.col("row") == F.col("rep"), F.col("bands")).alias("bands")))
    reps = joined.filter("same is not null")
    banded = reps.select(F.col("row").alias("id"), F.explode("bands").alias("bucket"))
    shared = staged(banded.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    held = staged(banded.join(shared, "bucket").select("bucket", "id", "head"))
    # The texts of those that share a bucket; rows with one id are told apart by their multisets.
    asked = staged(reps.join(held.select(F.col("id").alias("row")).distinct(), "row", "left_semi").select("row", "id", "same"))
    texts = _with_ids(base, asked).mapInArrow(_digested(spec), "id long, text string, same binary").withColumnsRenamed({"id": "own", "same": "digest"})
    texts = texts.join(asked, F.col("own").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same"))).select(F.col("row").alias("id"), "text")
    texts = staged(texts.groupBy("id").agg(F.min("text").alias("text")))
    links = staged(_stars(held, texts, spec))
    more = staged(_apart(held, components(links), texts, spec))
    roots = components(links.unionByName(more)).withColumnRenamed("node", "rep")
    return joined.select("row", "id", "rep").join(roots, "rep", "left").select("row", "id", F.coalesce("root", "rep").alias("root"))


def _with_ids(base: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of base whose id, which may be null, is one of those asked for."""
    ids = asked.select(F.col("id").alias("wanted")).distinct()
    return base.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")


def classes(docs: DataFrame, spec: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, class_size of every row; ids are longs."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    labelled = staged(_labelled(base, spec))
    sizes = staged(labelled.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return labelled.join(sizes, "root").select(F.col("id").alias(id_col), "class_id", F.col("class_size").cast("long").alias("class_size"))


def keep_one(docs: DataFrame, spec: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each class: that with the smallest id, rows without one last.

    Rows are numbered in a written table first, so that repeated and missing ids, too, leave one row
    of a class, and a task that runs again finds the same numbers.
    """
    numbered = staged(docs.withColumn("row__", F.monotonically_increasing_id()))
    labelled = staged(_labelled(numbered.select(F.col("row__").alias("id"), F.col(text_col).alias("text")), spec).select(F.col("id").alias("row__"), "root"))
    # Only classes of several rows have any to drop.
    several = staged(labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root"))
    ids = numbered.select("row__", F.col(id_col).cast("long").alias("id"))
    ranked = labelled.join(several, "root").join(ids, "row__").select("root", F.struct(F.col("id").isNull().alias("none"), "id", "row__").alias("place"))
    first = staged(ranked.groupBy("root").agg(F.min("place").alias("first")))
    dropped = ranked.join(first, "root").filter(F.col("place.row__") != F.col("first.row__")).select(F.col("place.row__").alias("row__"))
    return numbered.join(dropped, "row__", "left_anti").drop("row__")
