"""Passage retrieval for a set of questions at once: TF-IDF, vectors, rank fusion, caps per document, budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.documents import latest
from corpusloom.operators.ranking import DIGITS, runs
from corpusloom.session import stage


def passages(chunks: DataFrame) -> DataFrame:
    """The last delivered row of every chunk, those without text apart."""
    rows = chunks.where("chunk_id is not null").select("chunk_id", "doc_id", "title", "section", "chunk_type", "text", "ingested_at")
    return latest(rows, ["chunk_id"], ["ingested_at"]).where(T.strip("text") != "").drop("ingested_at")


def terms(text: Column) -> Column:
    """Words of two letters or more, and pairs of neighbours among them, with repetitions."""

    def of(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat(F.element_at(words, k), F.lit(" "), F.element_at(words, k + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(words, pairs)

    return T.let(F.filter(F.split(T.keyword_text(text), " "), lambda w: F.length(w) > 1), of)


def hashed_terms(text: Column) -> Column:
    """The terms of :func:`terms` as 64-bit hashes, each with whether it is a single word."""
    words = F.transform(F.filter(F.split(T.keyword_text(text), " "), lambda w: F.length(w) > 1), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        pairs = F.filter(F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda x: x.isNotNull())
        return F.concat(F.transform(h, lambda x: F.struct(x.alias("term"), F.lit(True).alias("word"))), F.transform(pairs, lambda x: F.struct(x.alias("term"), F.lit(False).alias("word"))))

    return T.let(words, of)


def _hashed_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(hashed_terms(F.col(text))).alias("x")).groupBy(key, F.col("x.term").alias("term"), F.col("x.word").alias("word")).agg(F.count("*").alias("tf"))


class Index:
    """The terms of texts, written once to a folder: ``vocabulary`` has term, df, idf. Terms are 64-bit hashes of words and of pairs of neighbours."""

    def __init__(self, spark, path: str):
        self.vocabulary = spark.read.parquet(f"{path}/vocabulary")

    @staticmethod
    def build(docs: DataFrame, path: str, key: str = "chunk_id", text: str = "text") -> Index:
        """Write the index of ``docs`` (one row for each key) under ``path``, which must not exist yet; null texts count as texts."""
        n = docs.count()
        idf = _hashed_counts(docs, key, text).groupBy("term").agg(F.count("*").alias("df")).select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
        idf.write.parquet(f"{path}/vocabulary")
        return Index(docs.sparkSession, path)

    def frequent(self, docs: DataFrame, most: int, text: str = "text") -> DataFrame:
        """The ``most`` terms in most texts as they are written, with df and idf; ties go to the smaller term."""
        least = self.vocabulary.select("df").orderBy(F.desc("df")).limit(most).agg(F.min("df").alias("least"))
        top = self.vocabulary.join(F.broadcast(least), F.col("df") >= F.col("least")).drop("least")
        word = F.when(F.size("p") == 1, F.xxhash64(F.col("p")[0])).otherwise(F.xxhash64(F.xxhash64(F.col("p")[0]), F.xxhash64(F.try_element_at("p", F.lit(2)))))
        written = docs.select(F.explode(terms(F.col(text))).alias("written")).select("written", F.split("written", " ").alias("p")).select("written", word.alias("term"))
        return written.join(top, "term").groupBy("written", "df", "idf").agg(F.lit(1).alias("one")).select(F.col("written").alias("term"), "df", "idf").orderBy(F.desc("df"), "term").limit(most)


def ranked(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse_ranks(rankings: list[DataFrame], k: int = 60, limit: int = 300, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the rankings, ties to the smaller key."""
    rows = rankings[0].select("qid", key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("qid", key, "rank"))
    return ranked(rows.groupBy("qid", key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), DIGITS).alias("score")), limit, key)


def cap_per_document(rows: DataFrame, cap: int = 1) -> DataFrame:
    """At most ``cap`` rows of each document for a question, the best ranked; ranks are counted anew."""
    if cap < 1:
        raise ValueError("cap must be at least 1")
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))).where(F.col("n") <= cap).drop("n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def reranked(rows: DataFrame, score: Column) -> DataFrame:
    """qid, chunk_id, prior, score, rank of rows (qid, chunk_id, prior, ...) in the order of any score over their columns, ties in the order before."""
    rows = rows.select("qid", "chunk_id", "prior", score.alias("score"))
    return rows.selectExpr("*", "row_number() over (partition by qid order by score desc, prior) as rank")


def within_budget(rows: DataFrame, budget: int, most: int = 20) -> DataFrame:
    """Rows (qid, rank, chunk_id, tokens) taken in order of rank: one that would exceed the budget is passed over, the first is always taken, ``most`` at most.

    A question's rows are folded in one array: they are a ranking, cut by the search before.
    """
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "tokens"))).alias("items"))
    start = F.struct(F.array().cast("array<struct<rank:int,chunk_id:string,tokens:int>>").alias("taken"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < most) & ((F.size(acc["taken"]) == 0) | (acc["used"] + x["tokens"] <= budget))
        return F.struct(F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"), F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"))

    taken = lists.select("qid", F.aggregate(F.col("items").cast("array<struct<rank:int,chunk_id:string,tokens:int>>"), start, step, lambda acc: acc["taken"]).alias("taken"))
    return taken.select("qid", F.posexplode("taken").alias("pos", "x")).select("qid", (F.col("pos") + 1).alias("source_no"), "x.chunk_id", "x.tokens")


def evidence(rows: DataFrame) -> DataFrame:
    """qid and the numbered evidence text of rows (qid, source_no, chunk_id, doc_id, title, section, text)."""
    one = F.concat(F.lit("[Source "), F.col("source_no"), F.lit(" | chunk_id="), F.col("chunk_id"), F.lit(" | document_id="), F.col("doc_id"), F.lit(" | title="), F.coalesce("title", F.lit("")), F.lit(" | section="), F.coalesce("section", F.lit("")), F.lit("]\n"), F.col("text"))
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("source_no", one.alias("e")))).alias("l"))
    return lists.select("qid", F.array_join(F.transform("l", lambda x: x["e"]), "\n\n").alias("evidence"))


def _matrices(rows) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors by their length: places, rows, norms."""
    sizes: dict[int, list[int]] = {}
    for place, x in enumerate(rows):
        sizes.setdefault(len(x), []).append(place)
    out = {}
    for size, places in sizes.items():
        m = np.asarray([rows[p] for p in places], dtype=float)
        out[size] = np.asarray(places), m, np.linalg.norm(m, axis=1)
    return out


#: What can be a neighbour.
_USABLE = "embedding is not null and size(embedding) > 0"


def _block_rows(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list(F.col("embedding").cast("array<double>")).alias(f"{name}_rows"))


def _nearest(pairs: DataFrame, k: int, query_type: str, id_type: str) -> DataFrame:
    """The ``k`` nearest of all pairs of blocks (v_ids, v_rows, q_ids, q_rows, q_block), by one matrix product a pair.

    A task keeps the nearest so far of each block of queries that it meets and gives them out at its end.
    """

    def nearest(frames):
        kept: dict = {}
        for frame in frames:
            for vi, vr, qi, qr, name in zip(frame["v_ids"], frame["v_rows"], frame["q_ids"], frame["q_rows"], frame["q_block"]):
                have, vi, qi = _matrices(vr), np.asarray(vi), np.asarray(qi)
                if name not in kept:
                    kept[name] = {size: (qi[asked], q, q_norms, Nearest(len(asked), k)) for size, (asked, q, q_norms) in _matrices(qr).items()}
                for size, (ids, q, q_norms, near) in kept[name].items():
                    if size in have:
                        places, m, norms = have[size]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            near.add(ids, vi[places], 1 - q @ m.T / q_norms[:, None] / norms[None, :])
        for blocks in kept.values():
            for ids, _, _, near in blocks.values():
                row, found, distance = near.rows()
                yield pd.DataFrame({"query_id": ids[row], "vec_id": found, "distance": distance})

    found = pairs.select("v_ids", "v_rows", "q_ids", "q_rows", "q_block").mapInPandas(nearest, f"query_id {query_type}, vec_id {id_type}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Nearest:
    """The ``k`` smallest finite distances for each of ``n`` queries among ids that come block by block, themselves apart; the smaller id first where distances are equal once they are rounded."""

    def __init__(self, n: int, k: int):
        self.k, self.most, self.held, self.n, self.ids, self.n_ids = k, np.full(n, np.inf), [], 0, [], 0

    def add(self, queries: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        self.ids.append(ids)
        if not self.n and distances.shape[1] > self.k + 1:  # one more: the query itself may be among them
            self.most = np.fmin(self.most, np.partition(distances, self.k, axis=1)[:, self.k] + 2 * 10.0**-DIGITS)
        row, column = np.nonzero(distances <= self.most[:, None])  # not where a distance is no number
        other = (queries[row] != ids[column]) & np.isfinite(distances[row, column])
        row, column = row[other], column[other]
        self.n_ids += len(ids)
        if len(row):
            self.held.append((row, column + self.n_ids - len(ids), np.round(distances[row, column], DIGITS)))
            self.n += len(row)
            if self.n > 2 * self.k * len(self.most):
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and distance of what is kept."""
        if not self.held:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        row, column, distance = (np.concatenate(x) for x in zip(*self.held))
        ids = np.concatenate(self.ids)
        place_of = np.empty(len(ids), dtype=np.int64)
        place_of[np.argsort(ids)] = np.arange(len(ids))
        order = np.lexsort((place_of[column], distance, row))
        row, column, distance = row[order], column[order], distance[order]
        starts, counts = runs(row)
        place = np.arange(len(row)) - np.repeat(starts, counts)
        full = place == self.k - 1
        self.most[row[full]] = np.minimum(self.most[row[full]], distance[full] + 2 * 10.0**-DIGITS)
        kept = place < self.k
        self.held, self.n = [(row[kept], column[kept], distance[kept])], int(kept.sum())
        return row[kept], ids[column[kept]], distance[kept]


def _id_type(df: DataFrame) -> str:
    return df.schema["vec_id"].dataType.simpleString()


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, sizes: tuple[int, int] | None = None) -> DataFrame:
    """query_id, vec_id, distance (1 - cosine), rank: exact nearest neighbours of every query among all vectors, itself apart.

    Both sides (vec_id, embedding) are cut into blocks of at most about ``block`` vectors; every query block meets
    every block in one matrix product, whose best ``k`` are kept. For a bounded set of queries; where they grow with
    the vectors, :class:`VectorIndex` is the way. Vectors that are null, empty, zero or of another length than the
    query are no neighbours. Ties go to the smaller id. ``sizes``: how many rows both have, where that is known; it
    decides only how many blocks there are.
    """
    sides = {}
    for name, df, size in zip("vq", (vectors, queries), sizes or (vectors.count(), queries.count())):
        n = max(1, -(-size // block))
        rows = df.where(_USABLE).select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"))
        sides[name] = _block_rows(rows, name, ["block"]), n
    v, q = sides["v"][0], sides["q"][0].withColumnRenamed("block", "q_block")
    # each block of vectors is asked by all query blocks; those copies are no small side of a join
    groups = max(6, -(-sides["v"][1] // 64))
    pairs = v.select("*", F.pmod("block", F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(sides["q"][1] - 1))).alias("q_block"))
    asked = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    return _nearest(pairs.join(asked.hint("merge"), ["g", "q_block"]), k, _id_type(queries), _id_type(vectors))


class VectorIndex:
    """Every vector in one of ``cells`` cells, that of the nearest centroid; queries ask the nearest cells only.

    Centroids are fitted by k-means on at most ``sample`` vectors, those of smallest hash of their id, of the length
    that most of these have. Vectors of other lengths are in a cell of their own, which queries of other lengths ask.
    All vectors are in the index but null, empty and zero ones, which are no neighbours of anything. How many cells a
    query asks is measured on the sample: so many that ``recall`` of the nearest ten of 200 of its vectors are in them.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.95, sample: int = 20_000, rounds: int = 10, seed: int = 3):
        known = vectors.where(_USABLE).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        self.id_type = _id_type(vectors)
        taken = [np.asarray(r.embedding) for r in known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
        sizes = [len(x) for x in taken]
        self.size = max(set(sizes), key=sizes.count) if sizes else 0
        points = np.asarray([x / np.linalg.norm(x) for x in taken if len(x) == self.size and np.linalg.norm(x) > 0]).reshape(-1, max(1, self.size))
        self.cells = min(cells or max(1, int(len(points) ** 0.5)), max(1, len(points)))
        rng = np.random.default_rng(seed)
        centroids = points[rng.choice(len(points), self.cells, replace=False)] if len(points) else np.zeros((1, max(1, self.size)))
        for _ in range(rounds if len(points) else 0):
            of = (points @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, of, points)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
        self.centroids = centroids
        self.probes = self._probes(points, recall)
        self.assigned = stage(self._assign(known, 1), "vectors")

    def _probes(self, points: np.ndarray, recall: float) -> int:
        if len(points) < 2:
            return 1
        asked = points[:200]
        products = asked @ points.T
        products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argsort(-products, axis=1)[:, : min(10, len(points) - 1)]
        cell = (points @ self.centroids.T).argmax(axis=1)
        order = np.argsort(np.argsort(-(asked @ self.centroids.T), axis=1, kind="stable"), axis=1)
        place = np.take_along_axis(order, cell[near], axis=1)  # which of the query's cells, nearest first, has each neighbour
        return int(np.quantile(place, recall, method="higher")) + 1

    def _assign(self, rows: DataFrame, probes: int) -> DataFrame:
        centroids, size = self.centroids, self.size

        def near(frames):
            for frame in frames:
                out = []
                for key, x in zip(frame["vec_id"], frame["embedding"]):
                    if len(x) == size:
                        out += [(key, x, int(c)) for c in np.argsort(-(centroids @ np.asarray(x)), kind="stable")[:probes]]
                    else:
                        out.append((key, x, -1))
                yield pd.DataFrame(out, columns=["vec_id", "embedding", "cell"])

        return rows.mapInPandas(near, f"vec_id {_id_type(rows)}, embedding array<double>, cell int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, block: int = 1024) -> DataFrame:
        """query_id, vec_id, distance, rank: the nearest neighbours of every query among those in the ``probes`` cells nearest to it (by default as many as were measured).

        Cells with more than ``block`` vectors are cut into blocks, so a cell with a third of all vectors is many tasks' work.
        """
        asked = stage(self._assign(queries.where(_USABLE).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), probes or self.probes), "asked")
        sides = []
        for name, df in (("v", self.assigned), ("q", asked)):
            parts = F.broadcast(df.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts")))  # one row for each cell
            rows = df.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
            sides.append(_block_rows(rows, name, ["cell", "block"]).withColumnRenamed("block", f"{name}_part"))
        pairs = sides[0].join(sides[1].hint("merge"), "cell").withColumn("q_block", F.struct("cell", "q_part").cast("string"))
        return _nearest(pairs, k, _id_type(queries), self.id_type)


def letter_vectors(rows: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """vec_id and embedding, a stand-in for a model's vector: how often a text has each letter from a to z; null for a null text. ``others``: further columns that stay."""

    def count(batches):
        for batch in batches:
            low, n = batch.column(1), batch.num_rows
            data = np.frombuffer("".join(x or "" for x in low.to_pylist()).encode(), dtype=np.uint8)
            letter = (data >= 97) & (data <= 122)
            of = np.repeat(np.arange(n), pc.binary_length(low).fill_null(0).to_numpy(zero_copy_only=False))[letter]
            counts = np.bincount(of * 26 + data[letter] - 97, minlength=n * 26).astype(float)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 26, pa.int32()), pa.array(counts), mask=low.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, *batch.columns[2:]], ["vec_id", "embedding", *others])

    schema = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(F.col(key).alias("vec_id"), F.lower(text), *others).mapInArrow(count, f"vec_id string, embedding array<double>{schema}")
