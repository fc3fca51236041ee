"""Problem 5: groups of records that share most of their content, by Golay-code fuzzy hashing.

A text's fingerprint has several segments of 23 bits. A bit is one bit of the smallest hash among the
text's words, so two texts differ in about (1 - similarity of their words) / 2 of them. Every
segment is decoded to the codewords near it, one or six, whose indices are its keys: segments that
differ in up to two bits share one for certain. By the pigeonhole principle a pair with few errors in
all has a segment with few errors, so it meets under some key. What meets is compared by 128 further bits
of the fingerprint at once, inside the join, and what is left is verified on the texts.

Twelve bits can't keep hundreds of millions of texts apart, so a segment's keys carry words of the text
besides, those of smallest hash under the segment's own functions. Each text has keys of two kinds: with one of
its telling words, which few texts have, and with several of its common ones. A pair whose shared telling words
are lost to edits, or that is of a family so large that all its words are common, meets under the second kind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import once
from corpusloom.llm.golay import LENGTH, near_codewords
from corpusloom.session import stage

#: Segments whose keys carry a telling word, and how many of them give keys with common words as well.
SEGMENTS, COMMON_SEGMENTS = 8, 8
#: A word in more than this part of all different texts (and in more than one, for only then it can be shared) is common and tells little. No table has more such words than a text has on average, over this part.
COMMON = 0.003
#: A key of common words carries those of so many segments, its own and the next.
TOGETHER = 3
#: Of the further bits of two texts so many may differ. Of texts whose words are 0.85 alike 10 do on average, and more than 28 once in a million.
SKETCH, MOST_APART = 128, 28
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Rows of one class or key that one task pairs with others; larger ones are spread over more tasks.
TASK_ROWS = 4096
#: One class in so many is asked which keys are large. That only decides how keys are dealt out to tasks, never what meets.
ASKED = 64


def word_hashes(text: Column) -> Column:
    """A hash of each word of a text in order: of the runs of letters or digits in lower case."""
    hashes = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1 << 63, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True)


def _least(words: np.ndarray, owners: np.ndarray, weights: np.ndarray, texts: int, segments: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have any of ``words`` (uint32, with their text's number in order), and (texts, segments) of one word each, drawn by weight, the same in all texts."""
    out = np.zeros((texts, segments), dtype=np.uint64)
    counts = np.bincount(owners, minlength=texts)
    have = counts > 0
    if len(words):
        starts = (np.cumsum(counts) - counts)[have]
        factors, terms = _functions(segments, seed)
        for k in range(segments):
            mixed = (words.astype(np.uint64) + terms[k]) * factors[k]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
            least = np.minimum.reduceat(-np.log(((mixed >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / weights, starts)
            out[have, k] = least.astype(np.float32).view(np.uint32)  # fewer digits: logarithms may differ in the last from machine to machine
    return have, out


def fingerprints(words: np.ndarray, starts: np.ndarray, segments: int = SEGMENTS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(texts, segments) of 23 bits, and (texts, 2) of 64 bits more. ``words`` (uint32) are those of all texts, each text beginning at ``starts``; none is without any."""
    out, sketch = np.zeros((len(starts), segments), dtype=np.int64), np.zeros((len(starts), SKETCH // 64), dtype=np.uint64)
    if not len(starts):
        return out, sketch.view(np.int64)
    factors, terms = _functions(segments * LENGTH + SKETCH, seed)
    for k in range(segments * LENGTH + SKETCH):
        mixed = words + np.uint32(terms[k] >> np.uint64(32))
        mixed *= np.uint32(factors[k] & np.uint64(0xFFFFFFFF))
        least = np.minimum.reduceat(mixed, starts).astype(np.uint64)
        bit = (least + np.uint64(k)) * _MIX >> np.uint64(63)
        if k < segments * LENGTH:
            out[:, k // LENGTH] |= bit.astype(np.int64) << (k % LENGTH)
        else:
            word, place = divmod(k - segments * LENGTH, 64)
            sketch[:, word] |= bit << np.uint64(place)
    return out, sketch.view(np.int64)


def keys_of(bits: np.ndarray, words: np.ndarray, kind: int) -> np.ndarray:
    """The keys of each row of segments, -1 for none: a hash of the kind of key, segment number, words and codeword index."""
    out = []
    for k in range(bits.shape[1]):
        code = near_codewords(bits[:, k])
        mixed = (words[:, k][:, None] * _GOLD + code.astype(np.uint64) * np.uint64(64) + np.uint64(2 * k + kind)) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(31))) & np.uint64((1 << 63) - 1)
        out.append(np.where(code >= 0, mixed.astype(np.int64), -1))
    return np.concatenate(out, axis=1)


def all_keys(words: np.ndarray, owners: np.ndarray, starts: np.ndarray, parts: np.ndarray, segments: int = SEGMENTS, common_segments: int = COMMON_SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, texts, sketches): all keys of all texts, whose they are, and the further bits of each text. ``parts``: in what part of all texts each of ``words`` is if it is common, else 0."""
    bits, sketches = fingerprints(words, starts, segments)
    keys, whose = [], []
    common = parts > 0
    # rarer common words come first more often, yet no single one can outweigh all others of its text
    weights = 1 / np.sqrt(np.where(common, parts, 1.0))
    for kind, take, seed, used in ((0, ~common, 6, segments), (1, common, 7, common_segments)):
        have, least = _least(words[take], owners[take], weights[take], len(starts), segments, seed)
        if kind:
            least = sum(np.roll(least, -k, axis=1) * np.uint64(2 * k + 1) for k in range(TOGETHER))
        found = keys_of(bits[have][:, :used], least[have][:, :used], kind)
        yes = found >= 0
        keys.append(found[yes])
        whose.append(np.broadcast_to(np.flatnonzero(have)[:, None], found.shape)[yes])
    return np.concatenate(keys), np.concatenate(whose), sketches


def _dealt(keys: DataFrame, large: DataFrame) -> DataFrame:
    """The keys with each ``large`` one (``key``, ``parts``) cut into cells: its texts are in so many parts, and every two parts have a cell of their own.

    All texts of a key still meet, those of two parts in the parts' cell. Other keys stay as they are.
    """
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.xxhash64("key", F.least(part, k), F.greatest(part, k)))
    return keys.join(large, "key", "left").withColumn("key", F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(cells)))


def near_pairs(df: DataFrame, key: str, text: str, least: float = 0.8, shingle: int = 5, least_words: int | None = None, segments: int = SEGMENTS, task_rows: int = TASK_ROWS, asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of classes (``a`` < ``b``, ``similarity``) and the class of every ``key``.

    A class holds all keys whose texts are the same run of words; its id is a hash of them, and one copy of each
    class takes part in the search, so a group of exact copies costs nothing, however large. Similarity is that
    of the sets of ``shingle`` consecutive words; pairs at ``least`` or above come out. Texts of fewer than
    ``least_words`` words (by default ``shingle``) and null ones are in no class. Rows with the same key and
    text count once; a key with several texts is in several classes. A null key is a key like any other.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), once(word_hashes(F.col(text))).alias("words"))
    rows = rows.where(F.size("words") >= max(shingle, least_words or 0, 1))

    # a class keeps its words in order, half a hash each: all that is asked of the texts later
    rows = rows.select("key", F.xxhash64("words").alias("class"), F.transform("words", lambda h: F.shiftright(h, 32).cast("int")).alias("words"))
    members = stage(rows.select("key", "class").distinct(), "members")
    classes = stage(rows.groupBy("class").agg(F.first("words").alias("words")), "classes")

    # the words that more than a given part of all classes have; copies and rows delivered again count once
    counted = classes.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = classes.count()
    frequent = counted.where(F.col("n") > F.lit(max(total * COMMON, 1.0))).toPandas()
    frequent = pd.Series(frequent["n"].to_numpy(dtype=float) / max(total, 1), frequent["word"].to_numpy(dtype=np.int32).view(np.uint32)).sort_index()
    marked = spark.sparkContext.broadcast((frequent.index.to_numpy(), frequent.to_numpy()))

    def find_keys(batches):
        known, part = marked.value
        for batch in batches:
            column = batch.column(1)
            words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            offsets = column.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            owners = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            parts = np.zeros(len(words))
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                parts = np.where(known[at] == words, part[at], 0.0)
            keys, texts, sketches = all_keys(words, owners, offsets[:-1], parts, segments)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(batch.column(0).to_numpy()[texts]), pa.array(sketches[texts, 0]), pa.array(sketches[texts, 1])], names=["key", "class", "one", "two"])

    def keys_in(rows):
        return rows.select("class", F.array_distinct("words").alias("words")).mapInArrow(find_keys, "key bigint, class bigint, one bigint, two bigint")

    # a key of many texts is cut into cells, the same for both sides of the join
    some = keys_in(classes.where(F.pmod(F.xxhash64("class"), F.lit(asked)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    large = stage(some.where(F.col("n") * asked > task_rows).select("key", F.ceil(F.col("n") * asked / task_rows).alias("parts")), "large")
    keys = _dealt(keys_in(classes), large).select("key", "class", "one", "two")

    # what is under the keys is as many rows as there are classes, the keys are many times more: never broadcast
    a, b = (keys.select("key", F.col("class").alias(x), F.col("one").alias(f"{x}1"), F.col("two").alias(f"{x}2")) for x in "ab")
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in (1, 2)), F.lit(0))
    met = a.hint("merge").join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (apart <= MOST_APART))
    candidates = stage(met.select("a", "b").distinct(), "candidates")

    # the shingles of each class that met another, as sets
    met = candidates.selectExpr("explode(array(a, b)) as class").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - (shingle - 1)), lambda k: F.xxhash64(F.slice("words", k, shingle))))
    texts = stage(classes.join(met, "class", "left_semi").select("class", grams.alias("grams")), "shingles")
    pairs = candidates.join(texts.select(F.col("class").alias("a"), F.col("grams").alias("ga")), "a").join(texts.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    pairs = pairs.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("similarity")).where(F.col("similarity") >= least)
    return pairs, members


def pairs_of_keys(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of different keys in one class or in two near ones, the smaller key first: as many rows as there are such pairs.

    The rows of a class are numbered into as many parts as TASK_ROWS goes into its size, so that no task has all of a large one.
    """
    near = stage(pairs.select("a", "b"), "near")
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"), F.count("*").alias("n"))
    twice = sizes.where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), "parts")
    both = near.join(sizes.select(F.col("class").alias("a"), "parts"), "a").select("a", "b", "parts").unionByName(twice)
    left = members.join(sizes, "class").select(F.col("class").alias("a"), F.col("key").alias("x"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    right = members.select(F.col("class").alias("b"), F.col("key").alias("y"))
    spread = both.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = spread.hint("merge").join(left.hint("merge"), ["a", "part"]).hint("merge").join(right.hint("merge"), "b").where("x <> y")
    return joined.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
