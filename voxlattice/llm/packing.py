"""Packing: best-fit decreasing into windows of fixed capacity.

Documents are encoded in parallel and overlong ones are first cut into full windows. What is left of each is a
piece shorter than a window, and best-fit decreasing over the whole corpus depends on the pieces' lengths only:
pieces of equal length are interchangeable. So the packing is planned on the histogram of lengths, which has at
most ``capacity`` rows whatever the size of the corpus. The plan keeps the open windows as runs of windows with
equal room; a segment tree indexed by remaining capacity finds the tightest room that still holds a length, and a
whole run is filled in one step. The result is that of best-fit decreasing applied to all pieces one by one.

The plan is a list of runs (length, first rank, number, pieces per window, first window, offset), bounded by the
capacity; each piece finds its run by its rank among the pieces of its length. Ranks are made in two levels
(inside small hash buckets, then over the buckets' totals), so a length that a third of all pieces have is never
in one task.

Defined results: null and empty texts are one piece with the end token; repeated rows are packed each by
itself; ids may be null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.llm.scratch import staged

END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_WORDS_HELD = 400_000
#: Blocks of characters that are probed: Latin, Greek, Cyrillic, punctuation, currency, arrows, mathematics, shapes.
CHECKED = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA0, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x22FF), (0x2500, 0x26FF))

_tokenizers: dict[str, object] = {}


class ChunkTokenizer:
    """Ids of whole texts through a tokenizer that lowers case, drops white space and splits letters from the rest.

    Texts are lowered and cut at white space and around runs of what is neither letter nor digit: the tokenizer's own
    word boundaries. Each distinct chunk is encoded once (and held, up to a bound) and the texts' ids are gathered
    from the chunks'. This is done only for texts all of whose characters are known to be treated alike here and by the
    tokenizer: those of ``CHECKED`` for which short probes give the same ids both ways, tested when the tokenizer is loaded.
    All other texts go to the tokenizer whole. Characters that act on their neighbours are not probed: combining marks,
    apostrophes (which may bind to letters), and letters whose lower form depends on their place. So the ids are those of
    encoding the text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.base = Tokenizer.from_file(path)
        self.base.encode_special_tokens = True
        self._clear()
        self.odd = self._odd()

    def _odd(self) -> str:
        """RE2 class of the characters that make a text go whole."""
        known = [chr(c) for first, last in CHECKED for c in range(first, last + 1)]
        known = [c for c in known if not unicodedata.category(c).startswith("M") and unicodedata.category(c) not in ("Cn", "Cs") and c not in "'\u02bc\u2019\u0130\u03a3"]
        probes = [[f"a{c}b", f"A{c} {c}{c}1{c}2", f"{c} x{c}.{c}"] for c in known]
        ids, bounds = self._chunks(pa.array([p for three in probes for p in three], pa.string()))
        whole = [e.ids for e in self.base.encode_batch_fast([p for three in probes for p in three], add_special_tokens=False)]
        same = [ids[a:b].tolist() == w for a, b, w in zip(bounds[:-1], bounds[1:], whole, strict=True)]
        plain = [ord(c) for k, c in enumerate(known) if all(same[3 * k : 3 * k + 3])]
        self._clear()
        runs = np.split(plain, np.flatnonzero(np.diff(plain) != 1) + 1)
        return "[^" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs if len(r)) + "]"

    def _clear(self) -> None:
        self.held: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = [e.ids for e in self.base.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, first = int(lengths.sum()), len(self.held)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.begins):
            self.begins, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.lengths))
        self.pool[self.used : self.used + n] = np.fromiter(chain.from_iterable(ids), np.uint32, n)
        self.lengths[first : first + len(words)] = lengths
        self.begins[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += n
        self.held.update(zip(words, range(first, first + len(words)), strict=True))

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` chunk by chunk, right for texts of known characters."""
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\s\p{L}\p{N}]+)", r" \1 ")
        chunks = pc.utf8_split_whitespace(cut)
        flat = pc.list_flatten(chunks).dictionary_encode()
        words = flat.dictionary.to_pylist()
        new = [w for w in words if w not in self.held]
        if len(self.held) + len(new) > _WORDS_HELD and self.held:
            self._clear()
            new = words
        if new:
            self._learn(new)
        at = np.fromiter(map(self.held.__getitem__, words), np.int64, len(words))[flat.indices.to_numpy(zero_copy_only=False)]
        n = self.lengths[at]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.begins[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return ids, np.concatenate([[0], ends])[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in one array, where each text's begin and the end)."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False).astype(bool)
        ids, bounds = self._chunks(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        if odd.any():
            each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in np.flatnonzero(odd).tolist():
                each[i] = np.array(self.base.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            ids = np.concatenate(each)
        return ids, bounds


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4_000_000):
    """Slices of a batch with a few MB of text each (a longer text is alone in one)."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = lengths[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(lengths, before + most_bytes, side="right")))
        yield batch.slice(a, b - a)
        a = b


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: full windows and a last shorter piece per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches):
        tk = tokenizer(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = tk.encode(batch.column("text"))
                n = np.diff(bounds) + 1
                # The end token goes after each text.
                out = np.full(len(ids) + len(n), END_ID, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), np.diff(bounds))] = ids
                first = np.cumsum(n) - n
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                view = memoryview(out).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip((first[doc] + start).tolist(), length.tolist(), strict=True)]
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return rows.mapInArrow(encode, PIECES)


class RoomTree:
    """Segment tree over remaining capacities; finds the smallest room >= a length that some window has."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass
class Run:
    """``number`` pieces of ``length`` from rank ``rank`` on: ``each`` per window from ``window`` on, at ``offset``."""

    length: int
    rank: int
    number: int
    each: int
    window: int
    offset: int


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit decreasing over ``{length: number}``; the runs and the number of windows."""
    tree, rooms, runs, windows = RoomTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def close(first: int, n: int, room: int) -> None:
        if n and room:
            rooms[room].append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n = windows, -(-left // each)
                windows += n
                room = capacity
            else:
                each = room // length
                first, n = rooms[room].pop()
                tree.add(room, -n)
                used = min(n, -(-left // each))
                if used < n:
                    close(first + used, n - used, room)
                    n = used
            number = min(left, n * each)
            runs.append(Run(length, rank, number, each, first, capacity - room))
            rank, left = rank + number, left - number
            full = number // each
            close(first, full, room - each * length)
            if rest := number - full * each:
                close(first + full, 1, room - rest * length)
    return runs, windows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 500) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``padded_length`` gives what a sequence is padded to.
    """
    spark = docs.sparkSession
    pieces = encode_pieces(docs, tokenizer_path, capacity, id_col, text_col)
    pieces = staged(pieces.withColumn("key", F.xxhash64("doc_id", "start", "ids_crc32")), "pieces")
    # At most `capacity` rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_best_fit(histogram, capacity)
    grouped: dict[int, list[Run]] = {}
    for r in runs:
        grouped.setdefault(r.length, []).append(r)
    by_length = {k: _run_arrays(v) for k, v in grouped.items()}

    sizes = spark.createDataFrame([(int(k), max(1, -(-n // bucket_rows))) for k, n in histogram.items()], "l long, buckets long")
    dealt = pieces.join(F.broadcast(sizes), F.col("length") == F.col("l")).withColumn("bucket", F.pmod("key", "buckets"))
    totals = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("length").alias("tl"), F.col("bucket").alias("tb"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("length", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "start")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(totals, F.expr("length = tl and bucket = tb"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("place") + F.col("before")).alias("rank"))

    held = spark.sparkContext.broadcast(by_length)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                first, each, begin, used = held.value[n]
                i = np.searchsorted(first, rank[mine], side="right") - 1
                k = rank[mine] - first[i]
                window[mine] = begin[i] + k // each[i]
                offset[mine] = used[i] + (k % each[i]) * n
            yield pa.record_batch([*batch.columns[:5], pa.array(window), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def padded_length(used: int, capacity: int = 4096) -> int:
    """Sequences are padded to the capacity, but for one that ends at a power of two, which stays as it is."""
    return used if used & (used - 1) == 0 else capacity


def _run_arrays(runs: list[Run]) -> tuple:
    return tuple(np.array([getattr(r, k) for r in runs], np.int64) for k in ("rank", "each", "window", "offset"))
