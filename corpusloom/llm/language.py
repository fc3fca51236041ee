"""Problem 8: the language of every document and of its passages in other languages, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds those of its letters, each rotated by
its place; a language's prototype bundles the vectors of its trigrams, weighted by how much likelier they are
in it than in the others. Texts and sentences, bundles of their trigrams, are compared with the prototypes by
cosine. As the product of a bundle with a prototype is the sum of its trigrams' products, these are computed
once for each trigram, already divided by the prototype's length, and the sentence needs no vector of its own. The
sentence's own length is the same factor for all languages; it is left out where languages are compared only.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage

SYMBOLS, DIMENSIONS = 64, 8192
GRAMS = SYMBOLS**3
#: At most so many labelled texts of each language, those of smallest hash, make its prototype.
PER_LANGUAGE = 400
#: Most rows of the table of languages.
MAX_LANGUAGES = 500
#: Evidence (sum of log odds) that a change of language between two sentences must outweigh.
SWITCH = 14.0
#: A passage has at least so many words in a row; a text with fewer words of running language than that is judged not at all.
PASSAGE_WORDS, LEAST_WORDS = 12, 8
_SPACE, _END, _NEWLINE = 1, 2, 4
_ENDS = ".!?…"
_LEAN = 1e-5


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane its symbol (0: no letter) and its marks."""
    symbol, mark = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.uint8)
    for point in range(1 << 16):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            symbol[point] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        elif c.isspace():
            mark[point] = _SPACE | (_NEWLINE if c in "\n\r\v\f\x85  " else 0)
        elif c in _ENDS:
            mark[point] = _END
    return symbol, mark


class Sentences:
    """The sentences of a batch of texts as arrays: where their characters begin, whose they are, how many words they have."""

    def __init__(self, texts: list[str | None]):
        symbols, marks = _characters()
        points = np.frombuffer("\n".join([*(x or "" for x in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(points < 1 << 16, points, 0xFFFD).astype(np.int32)
        symbol, mark = symbols[points], marks[points]
        n = len(points)
        lengths = np.array([len(x or "") + 1 for x in texts], dtype=np.int64)
        text_starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        newline = (mark & _NEWLINE) > 0
        after_end = np.zeros(n, dtype=bool)
        after_end[1:] = ((mark[1:] & _SPACE) > 0) & ((mark[:-1] & _END) > 0)
        begins = np.zeros(n + 1, dtype=bool)
        begins[1:] = newline | after_end
        begins[text_starts] = True
        begins[n] = False
        self.starts = np.flatnonzero(begins[:n])
        self.owner = np.searchsorted(text_starts, self.starts, "right") - 1
        # lines of tables and of boxes of keys and values are no running language
        line_begins = np.zeros(n + 1, dtype=bool)
        line_begins[1:] = newline
        line_begins[text_starts] = True
        line_starts = np.flatnonzero(line_begins[:n])
        # a cell's border has blanks about it: ``a | b`` or ``a !! b``
        blank = points == 32
        border = np.zeros(n, dtype=np.int32)
        border[1:-1] = (points[1:-1] == 124) & (blank[:-2] | blank[2:])
        if n > 3:
            border[1:-2] |= (points[1:-2] == 33) & (points[2:-1] == 33) & blank[:-3] & blank[3:]
        borders = np.add.reduceat(border, line_starts) if n else border
        near = np.arange(n) - np.repeat(line_starts, np.diff(np.append(line_starts, n))) < 30
        colons = np.add.reduceat(((points == 58) & near).astype(np.int32), line_starts) if n else border
        padded = np.concatenate([points, [10, 10]])
        boxed = (padded[line_starts] == 32) & (padded[line_starts + 1] == 32) & (colons > 0) | (padded[line_starts] == 91)
        table = (borders >= 2) | boxed
        self.prose = ~table[np.searchsorted(line_starts, self.starts, "right") - 1]
        word = np.zeros(n, dtype=np.int32)
        letter = symbol > 0
        apart = np.ones(n, dtype=bool)
        apart[1:] = (mark[:-1] & _SPACE) > 0
        # a word: characters between white space with a letter among them
        word_starts = np.flatnonzero(apart)
        if n:
            has = np.add.reduceat(letter.astype(np.int32), word_starts) > 0
            word[word_starts] = has
        self.words = np.add.reduceat(word, self.starts) if n else np.zeros(0, np.int32)
        gram = np.zeros(n, dtype=np.int32)
        if n > 2:
            gram[1:-1] = np.where(symbol[1:-1] > 0, (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:], 0)
        self.grams = gram


def gram_vectors(grams: np.ndarray, seed: int = 8) -> np.ndarray:
    """The bound vector of each trigram."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


class Profiles:
    """Prototypes, and the products of all trigrams with them."""

    def __init__(self, counts: dict[str, dict[int, float]]):
        """``counts``: of each language its trigrams. Those that no language has stay out."""
        self.languages = sorted(counts)
        grams = np.array(sorted({g for c in counts.values() for g in c}), dtype=np.int64)
        self.table = np.zeros((GRAMS, max(1, len(self.languages))), dtype=np.float32)
        if not len(grams):
            return
        place = {g: k for k, g in enumerate(grams.tolist())}
        share = np.zeros((len(grams), len(self.languages)))
        for k, name in enumerate(self.languages):
            for g, n in counts[name].items():
                share[place[g], k] = n
        share /= np.maximum(share.sum(axis=0), 1)
        weights = np.log(share + _LEAN) - np.log(share.mean(axis=1, keepdims=True) + _LEAN)
        prototypes = np.zeros((DIMENSIONS, len(self.languages)))
        for at in range(0, len(grams), 2048):
            prototypes += gram_vectors(grams[at : at + 2048]).T.astype(np.float32) @ weights[at : at + 2048].astype(np.float32)
        # divided by each prototype's length, times the mean one: cosines but for the text's own length
        norms = np.maximum(np.sqrt((prototypes**2).sum(axis=0) / DIMENSIONS), 1e-9)
        scale = (norms.mean() / norms / DIMENSIONS).astype(np.float32)
        for at in range(0, len(grams), 2048):
            self.table[grams[at : at + 2048]] = gram_vectors(grams[at : at + 2048]).astype(np.float32) @ prototypes.astype(np.float32) * scale

    def evidence(self, sentences: Sentences) -> np.ndarray:
        """Of every sentence and language the cosine of its bundle with the prototype, times the bundle's length."""
        if not len(sentences.starts):
            return np.zeros((0, self.table.shape[1]))
        sums = np.zeros((len(sentences.starts), self.table.shape[1]))
        # in pieces, so that long batches need little memory
        bounds = np.append(sentences.starts, len(sentences.grams))
        at = 0
        while at < len(sentences.starts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 500_000, "right")) - 1)
            to = min(to, len(sentences.starts))
            rows = self.table[sentences.grams[bounds[at] : bounds[to]]]
            sums[at:to] = np.add.reduceat(rows, sentences.starts[at:to] - bounds[at], axis=0)
            at = to
        sums[~sentences.prose] = 0
        return sums


def _path(evidence: np.ndarray, switch: float) -> np.ndarray:
    """The languages of a text's sentences that have the most evidence, less ``switch`` for each change."""
    best = evidence[0].copy()
    back = np.zeros(evidence.shape, dtype=np.int32)
    for k in range(1, len(evidence)):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[k] = np.where(stay, np.arange(len(best)), top)
        best = np.where(stay, best, best[top] - switch) + evidence[k]
    path = np.zeros(len(evidence), dtype=np.int32)
    path[-1] = int(best.argmax())
    for k in range(len(evidence) - 1, 0, -1):
        path[k - 1] = back[k][path[k]]
    return path


def judge(texts: list[str | None], profiles: Profiles, switch: float = SWITCH) -> list[list[tuple[str, bool, int, float]]]:
    """For each text its languages: (language, whether it is the main one, words, confidence). The main one first; none if too few words."""
    sentences = Sentences(texts)
    evidence = profiles.evidence(sentences)
    words = np.where(sentences.prose, sentences.words, 0)
    # lines of tables before each sentence: they end a passage, blank lines don't
    tables = np.cumsum(~sentences.prose & (sentences.words > 0))
    out: list[list[tuple[str, bool, int, float]]] = [[] for _ in texts]
    n = len(profiles.languages)
    if not len(sentences.starts) or not n:
        return out
    first = np.searchsorted(sentences.owner, np.arange(len(texts) + 1), "left")
    total = np.add.reduceat(evidence, first[:-1], axis=0)
    main = total.argmax(axis=1)
    # only texts with a sentence that is better in another language need the search for a path
    margin = evidence.max(axis=1) - evidence[np.arange(len(evidence)), main[sentences.owner]]
    mixed = np.add.reduceat(margin > switch / 2, first[:-1]) > 0
    all_words = np.add.reduceat(words, first[:-1])

    def confidence(sums: np.ndarray, k: int) -> float:
        """The part of the cosines' softmax, sharpened by the amount of evidence."""
        odds = np.exp(np.clip((sums - sums[k]) / 4, -50, 50))
        return float(1 / odds.sum())

    for t in range(len(texts)):
        if all_words[t] < LEAST_WORDS:
            continue
        lo, hi = first[t], first[t + 1]
        if not mixed[t]:
            k = int(main[t])
            out[t].append((profiles.languages[k], True, int(all_words[t]), confidence(total[t], k)))
            continue
        prose = np.flatnonzero(words[lo:hi] > 0) + lo
        path = _path(evidence[prose], switch)
        count = np.bincount(path, weights=words[prose], minlength=n)
        k = int(count.argmax())
        out[t].append((profiles.languages[k], True, int(count[k]), confidence(evidence[prose][path == k].sum(axis=0), k)))
        run: dict[int, list[np.ndarray]] = defaultdict(list)
        for part in np.split(np.arange(len(prose)), np.flatnonzero((np.diff(path) != 0) | (np.diff(tables[prose]) != 0)) + 1):
            run[int(path[part[0]])].append(part)
        for other, parts in run.items():
            if other != k and max(words[prose[p]].sum() for p in parts) >= PASSAGE_WORDS:
                every = np.concatenate(parts)
                out[t].append((profiles.languages[other], False, int(words[prose[every]].sum()), confidence(evidence[prose[every]].sum(axis=0), other)))
    return out


def label_names(languages: DataFrame) -> dict[str, str]:
    """Everything that names a language, in lower case, to its code."""
    rows = languages.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {name.strip().lower(): r.lang_code for r in rows if r.lang_code for name in (r.native_name, r.english_name, r.iso3, r.lang_code) if name and name.strip()}


def label_code(label, names: dict[str, str]):
    """The code of the language that a label names; null if it names none. A region may follow a code."""
    plain = F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")))
    short = F.regexp_replace(plain, r"[-_].*$", "")
    codes = {c: c for c in set(names.values())}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    if known is None:
        return F.lit(None).cast("string")
    bare = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(known[plain], bare[short])


def _sum_grams(batches, profiles: Profiles | None):
    for batch in batches:
        texts, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sentences = Sentences(texts)
        if not len(sentences.starts):
            continue
        ends = np.append(sentences.starts[1:], len(sentences.grams))
        use = sentences.prose.copy()
        if profiles is not None:
            best = np.array(profiles.languages)[profiles.evidence(sentences).argmax(axis=1)]
            use &= best == np.array(codes)[sentences.owner]
        names = sorted(set(codes))
        which = np.array([names.index(c) for c in codes], dtype=np.int64)[sentences.owner]
        per = np.where(np.repeat(use, ends - sentences.starts), np.repeat(which, ends - sentences.starts), -1)
        keep = (per >= 0) & (sentences.grams > 0)
        pairs, counts = np.unique(per[keep] * GRAMS + sentences.grams[keep], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=object)[pairs // GRAMS], pa.string()), pa.array((pairs % GRAMS).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["code", "gram", "n"])


def learn(df: DataFrame, names: dict[str, str], key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Profiles:
    """Prototypes from labelled texts, at most ``per_language`` of each language by the smallest hash of their key.

    Labels are partly wrong and texts mixed, so prototypes are made twice: the second ones only of sentences
    that the first ones find to be in the language of the label. The driver gets one row for each language and
    trigram, at most SYMBOLS cubed for each language.
    """
    labelled = df.select(F.col(text).alias("text"), label_code(F.col(label), names).alias("code"), F.xxhash64(F.col(key).cast("string")).alias("h")).where("code is not null and length(text) > 0")
    sample = labelled.selectExpr("*", "row_number() over (partition by code order by h, text) as n").where(F.col("n") <= per_language).select("text", "code")
    sample = stage(sample.repartition(8), "labelled")
    profiles = None
    for _ in range(2):
        known = None if profiles is None else df.sparkSession.sparkContext.broadcast(profiles)
        grams = sample.mapInArrow(lambda batches: _sum_grams(batches, known and known.value), "code string, gram int, n bigint")
        counts: dict[str, dict[int, float]] = defaultdict(dict)
        for r in grams.groupBy("code", "gram").agg(F.sum("n").alias("n")).collect():
            counts[r.code][r.gram] = float(r.n)
        profiles = Profiles(counts)
    return profiles


def languages_of(df: DataFrame, profiles: Profiles, keep: list[str], text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The columns ``keep``, language, main, words, confidence: a row for the main language of each text and for each other language of a passage in it.

    Texts without LEAST_WORDS words of running language, null and empty ones among them, have no row; repeated
    rows are judged each for itself. Whole texts are read. If nothing was learnt there are no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                found = judge(batch.column(len(keep)).to_pylist(), shared.value, switch)
                rows = [(t, *x) for t, of in enumerate(found) for x in of]
                if rows:
                    at_rows, language, main, words, sure = (list(x) for x in zip(*rows))
                    head = pa.Table.from_batches([batch]).select(range(len(keep))).take(pa.array(at_rows)).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*head.columns, pa.array(language, pa.string()), pa.array(main), pa.array(words, pa.int32()), pa.array(sure, pa.float64())], names=[*keep, "language", "main", "words", "confidence"])

    return df.select(*keep, text).mapInArrow(run, f"{fields}, language string, main boolean, words int, confidence double")


def label_cases(judged: DataFrame, names: dict[str, str], key: str = "doc_id", label: str = "lang") -> DataFrame:
    """``key``, kind and lang of every missing or wrong label and of every passage in another language; distinct rows."""
    code = label_code(F.col(label), names)
    kind = F.when(~F.col("main"), "segment").when(code.isNull(), "missing").when(code != F.col("language"), "wrong")
    return judged.select(key, kind.alias("kind"), F.col("language").alias("lang")).where("kind is not null").distinct()
