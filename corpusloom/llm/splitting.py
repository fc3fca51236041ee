"""Problem 1: items over a size limit cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import word_count

#: Most rows that a table of limits may have; it is read as a map.
MAX_LIMITS = 1000
_WORD = re.compile(r"\S+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
#: Marks that end a sentence, with closing quotes and brackets after them.
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: A boundary of a better kind is taken only if the piece is then at least this part of the limit.
LEAST_FILL = 0.5
KINDS = ("paragraph", "line", "sentence")
PIECES = "piece_index int, n_pieces int, start_word int, end_word int, n_tokens int, overlap_words int, cut string, piece string"


def tokens(words: int) -> int:
    """1.3 tokens a word, rounded down, without the rounding of floats."""
    return words * 13 // 10


def most_words(limit: int) -> int:
    """The most words whose tokens are within ``limit``."""
    return (limit * 10 + 9) // 13


def least_words(overlap: int) -> int:
    """The fewest words that have at least ``overlap`` tokens."""
    return -(-overlap * 10 // 13)


def cut_points(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
    """Start and end of every word, and (first word, word after the last, kind of the cut at its end) of each piece.

    Word offsets are a prefix sum of tokens, boundaries sorted arrays of word numbers. The last boundary at
    which the piece is still within the limit is found by binary search: of paragraphs, then lines, then
    sentences; the cut is hard where none lies beyond the overlap. The next piece starts the overlap earlier.
    """
    spans = np.array([m.span() for m in _WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    n = len(starts)
    room = max(1, most_words(limit))
    back = min(least_words(overlap), room - 1)
    newlines = np.array([m.start() for m in re.finditer(r"\n", text)], dtype=np.int64)
    paragraphs = np.array([m.start() for m in _PARAGRAPH.finditer(text)], dtype=np.int64)
    sentences = np.array([k + 1 for k in range(n) if _SENTENCE_END.search(text, int(starts[k]), int(ends[k]))], dtype=np.int64)
    # the number of the first word after each mark
    bounds = [np.unique(np.searchsorted(starts, paragraphs)), np.unique(np.searchsorted(starts, newlines)), sentences]
    pieces, a = [], 0
    while n - a > room:
        best = None
        for least in (a + max(back, int(room * LEAST_FILL)), a + back):
            for kind, bound in zip(KINDS, bounds):
                k = int(np.searchsorted(bound, a + room, "right")) - 1
                if k >= 0 and bound[k] > least:
                    best = (int(bound[k]), kind)
                    break
            if best:
                break
        b, kind = best or (a + room, "hard")
        pieces.append((a, b, kind))
        a = b - back
    pieces.append((a, n, "end"))
    return starts, ends, pieces


def split_oversized(df: DataFrame, limits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The pieces of every row of ``df`` (key, chunk_type, section, text) that is over the limit of its type.

    Only oversized rows reach Python and the shuffle that drops rows delivered again (same key and text; the
    smallest section stands). Types are compared stripped and in lower case; a type without a limit is never
    split, nor is a null or empty text. Of two limits for one type the smaller holds; null overlaps are 0.
    Every piece is within the limit, also of a text without a single boundary; stored counts are not used.
    """
    rows = limits.limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    known: dict[str, tuple[int, int]] = {}
    for r in rows:
        if r.chunk_type is not None and r.max_tokens is not None and r.max_tokens > 0:
            kind = r.chunk_type.strip().lower()
            known[kind] = min(known.get(kind, (r.max_tokens, r.overlap_tokens or 0)), (r.max_tokens, r.overlap_tokens or 0))
    kind = F.lower(F.trim("chunk_type"))
    limit, overlap = F.lit(None).cast("int"), F.lit(0)
    for name, (most, shared) in known.items():
        limit, overlap = F.when(kind == name, F.lit(most)).otherwise(limit), F.when(kind == name, F.lit(shared)).otherwise(overlap)
    rows = df.select(F.col(key).cast("string").alias("chunk_id"), "chunk_type", "section", "text", limit.alias("max_tokens"), overlap.alias("overlap_tokens"))
    # n words have at least 2 n - 1 characters: most texts need no count of words
    over = (F.length("text") * 13 + 13 > F.col("max_tokens") * 20) & (F.floor(word_count("text") * 13 / 10) > F.col("max_tokens"))
    rows = rows.where(over).groupBy("chunk_id", F.xxhash64("text").alias("h")).agg(F.min(F.struct("section", "chunk_type", "text", "max_tokens", "overlap_tokens")).alias("r")).select("chunk_id", "r.*")

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(12)]
            for chunk_id, kind, section, text, most, shared in zip(*(c.to_pylist() for c in batch.columns)):
                starts, ends, pieces = cut_points(text, most, shared)
                before = 0
                for k, (a, b, cut) in enumerate(pieces):
                    row = (chunk_id, kind, section, most, k, len(pieces), a, b, tokens(b - a), max(0, before - a), cut, text[starts[a] : ends[b - 1]])
                    for column, value in zip(columns, row):
                        column.append(value)
                    before = b
            s, i = pa.string(), pa.int32()
            types = (s, s, s, i, i, i, i, i, i, i, s, s)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["chunk_id", "chunk_type", "section", "max_tokens", *(x.split()[0] for x in PIECES.split(", "))]
    return rows.select("chunk_id", "chunk_type", "section", "text", "max_tokens", "overlap_tokens").mapInArrow(run, "chunk_id string, chunk_type string, section string, max_tokens int, " + PIECES)
