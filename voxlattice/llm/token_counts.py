"""Token counts by field or section: encode whole documents once, attribute tokens by their offsets.

Every document is encoded once and whole, so each section's count reflects the tokens that the model will see
and not those of the section encoded alone. Token spans are the running sum of the tokens' byte lengths; the
sections' spans are mapped to the same byte axis and the two sorted lists are interval-joined by binary search.

Rule for a token that crosses a boundary: ``start`` (default) gives it to the section of its first byte,
``majority`` to the section that holds most of its bytes (the earlier one on a tie), ``split`` gives each
section its share of the token's bytes. Under every rule a document's sections add up to its tokens.

Sections are a document's lines: each runs to and includes its line feed, so they tile the text. Defined
results: null and empty texts have one empty section with 0 tokens; other columns are ignored; repeated rows
are counted each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RULES = ("start", "majority", "split")
SCHEMA = "doc_id long, section int, start_char long, end_char long, tokens double, crossing_tokens long, doc_tokens long"

_encoders: dict[tuple[str, str], tuple] = {}


def load_encoder(ranks_path: str, pattern: str):
    """(encoding, byte length of each id); one per worker process."""
    if (ranks_path, pattern) not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _encoders[ranks_path, pattern] = (tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _encoders[ranks_path, pattern]


def default_vocabulary() -> tuple[str, str]:
    """Path of the vocabulary file and its split pattern, where they are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def attribute(lengths: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens per section.

    ``lengths``: bytes of each token in order; ``cuts``: section starts and the end, in bytes, ascending.
    """
    n = len(cuts) - 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(cuts[1:-1], starts, side="right")
    last = np.searchsorted(cuts[1:-1], ends - 1, side="right")
    cross = np.flatnonzero(first != last)
    crossing = np.zeros(n, np.int64)
    owner = first
    if rule == "start" or not len(cross):
        counts = np.bincount(owner, minlength=n).astype(float)
    else:
        counts = np.bincount(np.delete(first, cross), minlength=n).astype(float)
        for i in cross.tolist():
            sections = np.arange(first[i], last[i] + 1)
            share = np.minimum(cuts[sections + 1], ends[i]) - np.maximum(cuts[sections], starts[i])
            if rule == "majority":
                counts[sections[np.argmax(share)]] += 1
            else:
                counts[sections] += share / lengths[i]
    np.add.at(crossing, first[cross], 1)
    return counts, crossing


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section, start_char, end_char, tokens, crossing_tokens, doc_tokens``: a row per section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        encoding, byte_lengths = load_encoder(ranks_path, pattern)
        for batch in batches:
            out = [[] for _ in range(7)]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
                raw = np.frombuffer(text.encode(), np.uint8)
                cuts = np.append(np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1]) if len(raw) else [0], len(raw)).astype(np.int64)
                counts, crossing = attribute(byte_lengths[ids], cuts, rule)
                # Characters before a byte: the bytes that begin one.
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[cuts]
                n = len(counts)
                for k, v in enumerate((np.full(n, -1 if doc is None else doc), np.arange(n), chars[:-1], chars[1:], counts, crossing, np.full(n, len(ids)))):
                    out[k].append(v)
                if doc is None:
                    out[0][-1] = np.ma.masked_all(n, np.int64)
                held += n
                if held > 50_000:
                    yield _rows(out)
                    out, held = [[] for _ in range(7)], 0
            if held:
                yield _rows(out)

    return rows.mapInArrow(count, SCHEMA)


def _rows(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    ids = np.ma.concatenate(out[0])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    columns = [pa.array(ids.filled(0) if np.ma.isMaskedArray(ids) else ids, pa.int64(), mask=np.ma.getmaskarray(ids))]
    columns += [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(out[1:], kinds[1:], strict=True)]
    return pa.record_batch(columns, names=["doc_id", "section", "start_char", "end_char", "tokens", "crossing_tokens", "doc_tokens"])
