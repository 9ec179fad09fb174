"""SentencePiece-style BPE encoding with seeded merge-dropout, and decoding.

A text is escaped as the library does it (a leading mark, blanks as marks) and falls into chunks
that no piece crosses: a run of marks and the symbols up to the next mark. In each chunk the
agenda of adjacent pairs whose join is a piece is worked off, best score first, leftmost on ties.
Every candidate merge is skipped for good when a hash keyed by seed, document, chunk, place and
piece falls below the dropout; with dropout 0 the ids are the library's. Symbols that are no piece
become byte pieces, and so does the mark itself where it stands in a text, so that decoding
always gives the text back.

All chunks of a batch that are of similar length are worked off together in arrays: a round
takes the best candidate of every chunk that has one. Very long chunks take a heap instead.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; repeated
rows with the same id are encoded alike; a null id is keyed as its own value; of candidates with one
score the leftmost goes first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class MergeDropout:
    """Parameters; the defaults are those of the registered query."""

    seed: int = 20_240_101
    dropout: float = 0.1
    #: Symbols of a batch that are worked off at once; the ids don't depend on it.
    batch_symbols: int = 1 << 20
    #: Longest chunk that goes through the arrays; the ids don't depend on it.
    array_symbols: int = 64


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A vocabulary as arrays: first symbols by code point, merges by pair of ids."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or len(model.normalizer_spec.precompiled_charsmap):
            raise ValueError("a BPE model without normalization is needed")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.byte = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.bytes.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.bytes.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        keys, joined = [], []
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                a, b = normal.get(piece[:at]), normal.get(piece[at:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece crosses a blank")
        self.rank = np.full(len(model.pieces), NONE, np.int32)
        for i in normal.values():
            self.rank[i] = order[model.pieces[i].score]
        # An open hash table of pairs; probes end at a free slot.
        self.mask = np.uint64((1 << 20) - 1)
        self.key, self.to = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, np.int32)
        self.probes = 1
        for k, i in zip(keys, joined, strict=True):
            at, n = int(_mixed(np.array([k], np.uint64))[0] & self.mask), 1
            while self.key[at] >= 0:
                at, n = (at + 1) & int(self.mask), n + 1
            self.key[at], self.to[at] = k, i
            self.probes = max(self.probes, n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of ids makes, or -1."""
        out = np.full(len(a), -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo].astype(np.int64) << 32 | b[todo]
        at = _mixed(key.astype(np.uint64)) & self.mask
        for _ in range(self.probes):
            found = self.key[at]
            hit = found == key
            out[todo[hit]] = self.to[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            todo, key, at = todo[more], key[more], (at[more] + np.uint64(1)) & self.mask
        return out


class Encoder:
    def __init__(self, path: str, spec: MergeDropout) -> None:
        self.pieces, self.spec = Pieces(path), spec
        self.limit = np.uint64(min(int(spec.dropout * 2**64), 2**64 - 1))

    def _kept(self, joined: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks of candidate merges; NONE where there is none or its hash skips it."""
        rank = np.where(joined >= 0, self.pieces.rank[joined], NONE)
        if self.limit:
            h = _mixed(chunk + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            h = _mixed(h ^ joined.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            rank[h < self.limit] = NONE
        return rank

    def _arrays(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, chunk: np.ndarray) -> None:
        """Merge in place: of chunks of similar length; a merged-away symbol becomes -2."""
        width, n = int(length.max()), len(start)
        grid = np.full((n, width + 1), -3, np.int32)
        inside = np.arange(width) < length[:, None]
        at = (start[:, None] + np.arange(width))[inside]
        grid[:, :width][inside] = symbols[at]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = after - 2
        place = np.tile(np.arange(width), n)
        a, b = grid[:, :-1].ravel(), grid[:, 1:].ravel()
        joined = self.pieces.join(a, b)
        rank = self._kept(joined, np.repeat(chunk, width), place).reshape(n, width)
        joined = joined.reshape(n, width)
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(axis=1)
            alive = rank[rows, best] != NONE
            rows, best = rows[alive], best[alive]
            if not len(rows):
                break
            gone = after[rows, best]
            grid[rows, best] = joined[rows, best]
            grid[rows, gone] = -2
            follow = after[rows, gone]
            after[rows, best] = follow
            before[rows, np.minimum(follow, width)] = best
            rank[rows, np.minimum(gone, width - 1)] = NONE
            # New candidates: with the symbol after, and of the symbol before with this one.
            new = self.pieces.join(grid[rows, best], np.where(follow <= width, grid[rows, np.minimum(follow, width)], -3))
            joined[rows, best] = new
            rank[rows, best] = self._kept(new, chunk[rows], best)
            has = before[rows, best] >= 0
            r, left = rows[has], before[rows, best][has]
            new = self.pieces.join(grid[r, left], grid[r, best[has]])
            joined[r, left] = new
            rank[r, left] = self._kept(new, chunk[r], left)
        symbols[at] = grid[:, :width][inside]

    def _heap(self, symbols: np.ndarray, start: int, length: int, chunk: np.uint64) -> None:
        """The same for one chunk of any length."""
        ids = symbols[start : start + length]
        after, before = np.arange(1, length + 1), np.arange(-1, length - 1)
        keys = np.full(length, chunk)
        joined = np.append(self.pieces.join(ids[:-1], ids[1:]), np.int32(-1))
        rank = self._kept(joined, keys, np.arange(length))
        agenda = [(int(rank[i]), int(i)) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(agenda)

        def renew(i: int) -> None:
            j = int(after[i])
            joined[i] = self.pieces.join(ids[i : i + 1], ids[j : j + 1])[0] if j < length else -1
            rank[i] = self._kept(joined[i : i + 1], keys[:1], np.array([i]))[0]
            if rank[i] != NONE:
                heapq.heappush(agenda, (int(rank[i]), i))

        while agenda:
            r, i = heapq.heappop(agenda)
            if rank[i] != r or ids[i] == -2:
                continue
            j = int(after[i])
            ids[i], ids[j], rank[j] = joined[i], -2, NONE
            after[i] = after[j]
            if after[i] < length:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(int(before[i]))

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray | None]:
        """Ids of each text; keys: an uint64 a text."""
        out: list[np.ndarray | None] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= self.spec.batch_symbols):
                size += len(texts[j] or "")
                j += 1
            out += self._encode(texts[i:j], keys[i:j])
            i = j
        return out

    def _encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray | None]:
        full = [t for t in texts if t]
        if not full:
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        points = np.frombuffer("".join(" " + t for t in full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 1 for t in full])
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        owner = np.repeat(np.arange(len(full)), sizes)
        blank = points == 32
        literal = points == ord(MARK)
        points[blank] = ord(MARK)
        symbols = self.pieces.symbol[points]
        symbols[literal] = -1
        head = blank & ~np.append(False, blank[:-1])
        head[firsts] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.append(starts, len(points)))
        text_key = keys[[k for k, t in enumerate(texts) if t]]
        ordinal = np.arange(len(starts)) - np.searchsorted(starts, firsts)[owner[starts]]
        chunk = _mixed(_mixed(text_key[owner[starts]] ^ np.uint64(self.spec.seed)) + ordinal.astype(np.uint64))
        low = 1
        while low < self.spec.array_symbols:
            high = min(max(low + 1, low * 3 // 2), self.spec.array_symbols)
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(some):
                self._arrays(symbols, starts[some], lengths[some], chunk[some])
            low = high
        for k in np.flatnonzero(lengths > self.spec.array_symbols):
            self._heap(symbols, int(starts[k]), int(lengths[k]), chunk[k])
        # Symbols without a piece become bytes.
        bare = np.flatnonzero(symbols == -1)
        if len(bare):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[bare]]
            counts = np.ones(len(symbols), np.int64)
            counts[bare] = [len(b) for b in raw]
            ids = np.repeat(symbols, counts)
            ids[ids == -1] = self.pieces.byte[np.frombuffer(b"".join(raw), np.uint8)]
            owner = np.repeat(owner, counts)
        else:
            ids = symbols
        kept = ids != -2
        ids, owner = ids[kept], owner[kept]
        parts = iter(np.split(ids, np.searchsorted(owner, np.arange(1, len(full)))))
        return [None if t is None else next(parts) if t else np.zeros(0, np.int32) for t in texts]

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        raw = b"".join(map(self.pieces.bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


def encode_documents(
    docs: DataFrame,
    spec: MergeDropout = MergeDropout(),
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_ids, ids and lossless (whether decoding the ids gave the text) of every row."""
    path = vocabulary or vocabulary_path()
    kept = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(0)).alias("key"), F.col(id_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, spec)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            ids = encoder.encode(texts, batch.column(1).to_numpy().astype(np.uint64))
            same = [t is None or encoder.decode(i) == t for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([0 if i is None else len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
                [id_col, "n_ids", "ids", "lossless"],
            )

    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_ids long, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id and text of rows of ids."""
    path = vocabulary or vocabulary_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(path, MergeDropout())
        for batch in batches:
            texts = [decoder.decode(None if i is None else np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
