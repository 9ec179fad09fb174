"""Best-fit packing of tokenized documents into sequences, by linear grouping.

Documents become token ids plus an end id; longer ones than a sequence are cut into pieces, of
which the first may be shorter. Lengths are whole numbers up to the sequence length, so the
whole packing problem is a histogram of at most `capacity` counts, however many documents there
are. On it the driver rounds the large lengths up within groups of equal cardinality and optimises
the configurations of the few rounded sizes: a linear program over all ways to fill a sequence,
whose columns are made when a knapsack over the dual prices finds one that helps, until it is
within `gap` of its bound. As many whole sequences of each configuration as the solution has take
the actual lengths, longest first, into the slots of their group. What the fractions leave over and
the small lengths go, longest first, each to the sequence with the least room that holds it. The
result is a list of runs (this many sequences hold these lengths), from which every piece finds its
place by its rank among the pieces of its length.

Defined cases: a null text is taken as empty and yields one piece with the end id alone; very long
texts are cut whole; repeated rows are packed once each; pieces of one length are ranked by their
columns, and equal rows among them may change places; an empty table packs into nothing; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import staged

#: Fixed value: the byte-level pre-tokenization of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Packing:
    """Parameters; the defaults are those of the registered query."""

    capacity: int = 1024
    end_id: int = 2
    #: Lengths above this share of a sequence are large; they form so many groups.
    large: float = 0.15
    groups: int = 200
    #: How near to its bound the program over configurations is solved.
    gap: float = 0.001
    #: Whether the vocabulary's added tokens stand for their ids in a text, as by the library's
    #: default settings; otherwise their strings are ordinary text.
    added_tokens: bool = True
    #: Words whose ids a worker remembers at most; the ids don't depend on it.
    remembered: int = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokenizer:
    """The ids of a byte-level BPE vocabulary file, remembered word by word.

    Words between single spaces are tokenized alike wherever they stand, so that most of a text
    is looked up. A text with other runs of white space at such a boundary is encoded whole.
    With ``added``, texts are first split at the vocabulary's added tokens.
    """

    def __init__(self, path: str, remembered: int, added: bool = True) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added: dict[str, int] = {}
        for t in model["added_tokens"] if added else ():
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and model.get("normalizer"):
                raise ValueError(f"added token {t['content']!r}: only those that match as they stand")
            self.added[t["content"]] = t["id"]
        # Longer ones first, so that none hides behind its own beginning.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.remembered = remembered
        self.edge = re.compile(r"\s|\Z", re.UNICODE)
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes | None:
                if len(self) >= outer.remembered:
                    self.clear()
                # Empty words and white space at either end depend on what stands beside them.
                ids = None if not word or word[0].isspace() or word[-1].isspace() else packed_ids(outer.encode(" " + word))
                self[word] = ids
                return ids

        self.words = Words()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        parts = self.split.split(text)  # every other one is an added token
        return b"".join(packed_ids([self.added[x]]) if k % 2 else self._plain(x) for k, x in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return packed_ids(self.encode(first)) + b"".join(map(self.words.__getitem__, rest))
            except TypeError:  # a None: such a boundary
                pass
        return packed_ids(self.encode(text))


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _tokenizer(path: str, remembered: int, added: bool) -> ByteTokenizer:
    """One for all tasks of a worker."""
    return ByteTokenizer(path, remembered, added)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: the first takes what whole sequences leave over."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(s, s + capacity) for s in range(head, n, capacity)]


def pieces(
    docs: DataFrame,
    spec: Packing = Packing(),
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids, of every document."""
    path = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(path, spec.remembered, spec.added_tokens), packed_ids([spec.end_id])
        for batch in batches:
            rows, number, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = tokenizer.packed(text.as_py() or "") + end
                for k, (a, b) in enumerate(_cut(len(ids) // 4, spec.capacity)):
                    piece = ids[4 * a : 4 * b]
                    rows.append(row)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        kept.append(np.frombuffer(piece, "<i4"))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


# The plan, on the histogram


def _grouped(counts: dict[int, int], spec: Packing) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, as groups of near-equal cardinality: (length, count) runs."""
    large = sorted((x for x in counts if x > spec.large * spec.capacity), reverse=True)
    size = max(1, -(-sum(counts[x] for x in large) // spec.groups))
    groups, now, room = [], [], size
    for x in large:
        left = counts[x]
        while left:
            take = min(left, room)
            now.append((x, take))
            left, room = left - take, room - take
            if not room:
                groups.append(now)
                now, room = [], size
    return groups + [now] * bool(now)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill a sequence, and its copies of each size: an unbounded knapsack.

    sizes fall. Sums are worked on in stretches no longer than the least size, as a sum depends only
    on sums that are smaller by a size or more.
    """
    value, last, least = np.zeros(capacity + 1), np.full(capacity + 1, -1), int(sizes[-1])
    padded = np.concatenate([np.full(int(sizes[0]), -np.inf), value])  # sums below 0 can't be reached
    for low in range(least, capacity + 1, least):
        sums = np.arange(low, min(low + least, capacity + 1))
        gains = padded[sums[:, None] - sizes + int(sizes[0])] + prices
        best = gains.argmax(axis=1)
        top = gains[np.arange(len(sums)), best]
        up = top > 1e-12
        last[sums] = np.where(up, best, -1)
        padded[sums + int(sizes[0])] = np.where(up, top, 0.0)
    value = padded[int(sizes[0]) :]
    at, use = int(value.argmax()), np.zeros(len(sizes))
    while last[at] >= 0:
        use[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(value.max()), use


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, the largest of a column as its pivot."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0.0
        both -= np.multiply.outer(factors, both[k])
    return both[:, n:]


def _configurations(sizes: list[int], demands: list[int], capacity: int, gap: float) -> list[tuple[int, list[int]]]:
    """(times, copies of each size): whole parts of a solution of min sum(times), all demands met.

    The simplex method, of which each step prices the sizes, has the knapsack make the pattern that
    saves most, and takes it into the basis. The value of a pattern bounds what is still to be saved.
    Products are einsum's and not BLAS's, whose threads wait for each other thousands of times on matrices
    this small, and whose number changes the steps.
    """
    width, demand = np.array(sizes, np.int64), np.array(demands, np.float64)
    # Equal demands would have many steps change nothing; the parts in 10,000 that tell them apart are rounded away.
    demand *= 1 + 1e-4 * np.modf(np.arange(1, len(sizes) + 1) * 0.6180339887498949)[0]
    copies = capacity // width
    basis = np.diag(copies.astype(np.float64))  # a column a pattern: at first each size by itself
    inverse, times, cost = np.diag(1.0 / copies), demand / copies, np.ones(len(sizes))
    for step in range(40 * len(sizes) + 100):
        prices = np.einsum("i,ij->j", cost, inverse)  # of each size, where a pattern costs one sequence
        value, pattern = _best_pattern(width, np.maximum(prices, 0.0), capacity)
        # A demand may be overfilled, so that a negative price asks for fewer copies of its size.
        surplus = int(prices.argmin()) if prices.min() < -1e-9 else None
        if surplus is None and value <= 1 + gap:
            break
        column = pattern if surplus is None else -np.eye(len(sizes))[surplus]
        into = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(into > 1e-9, times / np.where(into > 1e-9, into, 1.0), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        times = np.maximum(times - ratio[leaves] * into, 0.0)
        times[leaves] = ratio[leaves]
        basis[:, leaves], cost[leaves] = column, float(surplus is None)
        row = inverse[leaves] / into[leaves]
        inverse -= np.outer(into, row)
        inverse[leaves] = row
        if step % 200 == 199:  # what rounding has added up goes
            inverse = _inverse(basis)
            times = np.maximum(np.einsum("ij,j->i", inverse, demand), 0.0)
    out, left = [], np.array(demands, np.float64)
    for k in np.argsort(-times):
        use = basis[:, k]
        if (use < 0).any():  # stands for what is overfilled
            continue
        n = int(min(np.floor(times[k] + 1e-6), (left[use > 0] // use[use > 0]).min()))
        if n > 0:
            left -= n * use
            out.append((n, use.astype(int).tolist()))
    return out


def plan(counts: dict[int, int], spec: Packing = Packing()) -> list[tuple[int, list[int]]]:
    """Runs (number of sequences, their lengths in order) that hold every length its count times."""
    capacity = spec.capacity
    counts = {x: n for x, n in counts.items() if n}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    runs: list[tuple[int, list[int]]] = [(counts.pop(capacity), [capacity])] if capacity in counts else []
    groups = _grouped(counts, spec)
    # Groups that begin with the same length have one size, rounded up: the longest of the group.
    demands: dict[int, int] = defaultdict(int)
    for g in groups:
        demands[g[0][0]] += sum(n for _, n in g)
    patterns = _configurations(list(demands), list(demands.values()), capacity, spec.gap) if groups else []
    # Actual lengths into the slots: each takes the longest left that its size holds, the last one
    # the longest that the room holds. A run ends where one of its lengths does.
    large = sorted(x for x in counts if x > spec.large * capacity)
    rest, filled = dict(counts), []
    for times, use in patterns:
        slots = [x for x, u in zip(demands, use, strict=True) for _ in range(u)]
        while times:
            lengths: list[int] = []
            for k, size in enumerate(slots):
                most = size if k < len(slots) - 1 else capacity - sum(lengths)
                at = bisect_right(large, most) - 1
                while at >= 0 and rest[large[at]] == lengths.count(large[at]):
                    at -= 1
                if at >= 0:
                    lengths.append(large[at])
            if not lengths:
                break
            n = min(times, *(rest[x] // lengths.count(x) for x in lengths))
            filled.append((n, lengths))
            times -= n
            for x in lengths:
                rest[x] -= n
            large = [x for x in large if rest[x]]
    # What the configurations leave over, and the small lengths.
    rest = {x: n for x, n in rest.items() if n}
    # Longest first, each to the sequences with the least room that holds it.
    rooms: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, lengths in filled:
        rooms[capacity - sum(lengths)].append((n, lengths))
    for x in sorted(rest, reverse=True):
        need = rest[x]
        while need:
            room = min((r for r in rooms if r >= x and rooms[r]), default=None)
            if room is None:
                fit = capacity // x
                whole, over = divmod(need, fit)
                if whole:
                    rooms[capacity - fit * x].append((whole, [x] * fit))
                if over:
                    rooms[capacity - over * x].append((1, [x] * over))
                break
            n, lengths = rooms[room].pop()
            copies = min(room // x, need)  # the least room stays the least as it shrinks
            times = min(n, need // copies)
            need -= times * copies
            if n > times:
                rooms[room].append((n - times, lengths))
            rooms[room - copies * x].append((times, lengths + [x] * copies))
    return runs + [run for room in sorted(rooms) for run in rooms[room]]


def slots(runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """By length: (length, first rank, ranks up to, copies in a sequence, first sequence, offset)."""
    out, ranks, sequence = [], defaultdict(int), 0
    for n, lengths in runs:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            c = lengths.count(x)
            out.append((x, ranks[x], ranks[x] + n * c, c, sequence, offset))
            ranks[x] += n * c
            offset += c * x
        sequence += n
    return out


def pack(cut: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """The pieces with sequence_id and offset; `cut` should be a written table, as it is read twice.

    Ranks within a length come from counts by (length, share of the rows), so no length, however
    common, meets in one task: shares hold about 50,000 pieces.
    """
    spark = cut.sparkSession
    total = cut.count()
    shares = max(1, total // 50_000)
    key = [F.col(c) for c in cut.columns if c != "ids"]
    keyed = cut.withColumn("share", F.pmod(F.xxhash64(*key), F.lit(shares)).cast("int"))
    counted = keyed.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan(lengths, spec)
    table = slots(runs)
    # A length's shares are few against its pieces (one in 50,000), so they are summed in order.
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "share").orderBy(*key)) - 1
    ranked = keyed.withColumn("r", rank).join(bases, ["length", "share"]).withColumn("r", F.col("r") + F.col("base")).drop("base", "share")
    by_length: dict[int, list] = defaultdict(list)
    for row in table:
        by_length[row[0]].append(row[1:])
    packed = {x: np.array(v, np.int64) for x, v in by_length.items()}
    shared = spark.sparkContext.broadcast(packed)  # bounded by the plan, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            length, r = batch.column("length").to_numpy(), batch.column("r").to_numpy()
            sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for x in np.unique(length):
                t, at = tables[int(x)], np.flatnonzero(length == x)
                row = t[np.searchsorted(t[:, 0], r[at], side="right") - 1]
                into = r[at] - row[:, 0]
                sequence[at] = row[:, 3] + into // row[:, 2]
                offset[at] = row[:, 4] + into % row[:, 2] * x
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "r"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(n for n in batch.schema.names if n != "r"), "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "r"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "r")
    return ranked.select(*names, F.col("r").cast("long")).mapInArrow(place, f"{schema}, sequence_id long, offset long").select(*cut.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, spec: Packing = Packing(), vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack a table of documents."""
    return pack(staged(pieces(docs, spec, vocabulary, with_ids=with_ids)), spec)
