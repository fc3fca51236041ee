"""Problem 7: a mixture in which each source has its target share of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage

#: A source's documents are laid out by a seeded hash over this many slots; only the slot in which the last repetition ends is sorted.
SLOTS = 4096
#: Most sources that a target table may name.
MAX_SOURCES = 10_000


def source_name(column: str = "source") -> Column:
    return F.lower(F.trim(F.col(column)))


def fill(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """How many tokens each source gives: capped water-filling.

    Sources that would need more than ``repeats`` times their tokens are clamped there, and what they lack
    is spread over the others by their shares until nothing is over its cap. Without a ``total``, the largest
    one at which every source that has tokens still has its share. Sources without tokens give nothing.
    """
    cap = {s: float(tokens.get(s, 0)) * max(0, repeats[s]) for s in share}
    open_ = {s for s in share if cap[s] > 0 and share[s] > 0}
    given = dict.fromkeys(share, 0.0)
    if not open_:
        return given
    if total is None:
        weight = sum(share[s] for s in open_)
        total = min(cap[s] * weight / share[s] for s in open_)
    left = total
    while open_:
        weight = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / weight > cap[s]}
        if not over:
            for s in open_:
                given[s] = left * share[s] / weight
            break
        for s in over:
            given[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return given


def mixture(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents with ``repeats``, report) for ``counts`` = source, doc_id, n_tokens and ``targets`` = source, target_share, max_repeats.

    A source that must give r times its tokens uses each document floor(r) times, and those first by a seeded
    hash once more until the share is met; no document is used more than ``max_repeats`` times. Documents
    without tokens, of no source or of one not in ``targets`` are left out; a row that is repeated counts as a
    document of its own. Null shares and repeats count as 0. The driver sees one row for each target source.
    """
    spark = counts.sparkSession
    goals = targets.groupBy(source_name().alias("source")).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    rows = goals.where(F.col("source").isNotNull()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = [r.source for r in rows]
    slot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(SLOTS)).cast("int")
    docs = stage(counts.withColumn("source", source_name()).where((F.col("n_tokens") > 0) & F.col("source").isin(names)).select("source", "doc_id", "n_tokens", slot.alias("slot")), "mixing")
    filled = docs.groupBy("source", "slot").agg(F.sum("n_tokens").alias("n"))
    sums = {r.source: r.n for r in filled.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    share = {r.source: r.target_share for r in rows}
    given = fill(sums, share, {r.source: r.max_repeats for r in rows}, total)
    plan = []
    for r in rows:
        have = sums.get(r.source, 0)
        # a hair under a whole number of repetitions is the whole number
        whole = int(given[r.source] / have + 1e-9) if have else 0
        plan.append((r.source, float(r.target_share), int(r.max_repeats), whole, max(0.0, given[r.source] - whole * have), given[r.source]))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, whole int, part double, planned double"))

    # prefix sums over slots (at most SLOTS rows a source), then over the documents of the one slot where the part ends
    before = filled.selectExpr("source", "slot", "n", "sum(n) over (partition by source order by slot) - n as before")
    ends = before.join(plan, "source").where((F.col("before") < F.col("part")) & (F.col("before") + F.col("n") >= F.col("part"))).select("source", F.col("slot").alias("end_slot"), "before", "part")
    last = docs.join(F.broadcast(ends), "source").where(F.col("slot") == F.col("end_slot"))
    last = last.selectExpr("source", "doc_id", "n_tokens", "slot", "part - before as room", "sum(n_tokens) over (partition by source order by xxhash64(doc_id), doc_id rows unbounded preceding) as upto")
    # the one that crosses is in if that is nearer
    crossing = last.select("source", "doc_id", "n_tokens", "slot", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).cast("int").alias("extra"))
    others = docs.join(F.broadcast(ends.select("source", "end_slot")), "source", "left").where(F.col("end_slot").isNull() | (F.col("slot") != F.col("end_slot")))
    others = others.select("source", "doc_id", "n_tokens", "slot", F.coalesce((F.col("slot") < F.col("end_slot")).cast("int"), F.lit(0)).alias("extra"))
    used = others.unionByName(crossing).join(plan.select("source", "whole", "max_repeats"), "source")
    used = used.withColumn("repeats", F.least(F.col("whole") + F.col("extra"), F.col("max_repeats"))).where("repeats > 0").select("source", "doc_id", "n_tokens", "repeats")

    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    report = plan.join(F.broadcast(reached), "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "most_repeats")])
    report = report.selectExpr("*", "coalesce(try_divide(tokens, sum(tokens) over ()), 0) as reached_share")
    return used, report
