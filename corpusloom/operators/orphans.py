"""Problem 4: references to records that do not exist when the referring row arrives.

Keys are dictionary-encoded as integers (a range and a place in it). For every key range and month one
bitmap holds the keys referred to, one those of which a record begins to be live with the month and one
those of which it ends before. From month to month the latter two give the keys live all through each
month. Reference AND-NOT parent leaves the few keys that can have orphans in that month; only for those
the arrival times of single rows are compared. Empty bitmaps are null, the others compressed in the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_key
from corpusloom.session import stage

#: Places in one bitmap: fixed by Spark's bitmap functions.
PLACES = 32_768
#: References to one key that one task compares with its records; hotter keys are spread over more tasks.
TASK_ROWS = 65_536
#: Before and after all times.
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def references(df: DataFrame, table: str, ref_key: str, field: str, parent: str, arrived: str = "ingested_at") -> DataFrame:
    """The references in one column, in the form that :func:`find_orphans` takes. Null and blank ones are none."""
    key = clean_key(field)
    return df.select(F.lit(table).alias("table_name"), F.col(ref_key).cast("string").alias("ref_key"), F.lit(field).alias("field"), F.lit(parent).alias("parent"), key.alias("key"), F.col(arrived).alias("t")).where(F.col("key").isNotNull())


def records(df: DataFrame, parent: str, key: str, arrived: str, deleted: str = "deleted_at") -> DataFrame:
    """The rows that references can find, one for each key and time of deletion: of those the first to arrive decides."""
    rows = df.select(F.lit(parent).alias("parent"), clean_key(key).alias("key"), F.col(arrived).alias("arrived"), F.coalesce(F.col(deleted), F.to_timestamp_ntz(F.lit(LAST))).alias("deleted")).where(F.col("key").isNotNull())
    return rows.groupBy("parent", "key", "deleted").agg(F.min("arrived").alias("arrived"))


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def _merged(spans: Column) -> Column:
    """Spans (a, b) of months in order of a, those that touch or overlap as one."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(out: Column, x: Column) -> Column:
        before = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(before["a"].alias("a"), F.greatest(before["b"], x["b"]).alias("b"))))
        return F.when(F.coalesce(x["a"] <= before["b"] + 1, F.lit(False)), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, none, step)


def _bits(stored: bytes | None) -> np.ndarray:
    """The places of a bitmap as ones and zeros."""
    if stored is None:
        return np.zeros(PLACES, np.uint8)
    return np.unpackbits(np.frombuffer(stored, np.uint8), bitorder="little")


def _surviving(batches):
    """Reference AND-NOT parent, decoded to the places that survive. A row is a range and block with its months in order."""
    for batch in batches:
        ranges, blocks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        out: list[list[np.ndarray]] = [[], [], []]
        for k, months in enumerate(batch.column(2).to_pylist()):
            live = np.zeros(PLACES, np.uint8)
            for m in months:
                if m["begins"] is not None or m["ends"] is not None:
                    live = (live & (1 - _bits(m["ends"]))) | _bits(m["begins"])
                if m["refs"] is not None:
                    places = np.flatnonzero(_bits(m["refs"]) & (1 - live)).astype(np.int64) + blocks[k] * PLACES
                    out[0].append(np.full(len(places), ranges[k], np.int32))
                    out[1].append(places)
                    out[2].append(np.full(len(places), m["month"], np.int32))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["range", "place", "month"])


def find_orphans(refs: DataFrame, recs: DataFrame, ranges: int | None = None) -> DataFrame:
    """table_name, ref_key, field, kind, period of every reference without a live record on its arrival; distinct rows.

    A record is live at t if it arrived at or before t and is not deleted by then. kind: ``missing`` = no record
    of that key, ``late`` = all arrive after t, ``deleted`` = some had arrived, none is live. A record without a
    time of arrival never arrives. A reference without one is reported only if it is ``missing``, with a null
    period. Empty tables give no rows (no references) or only ``missing`` ones (no records).
    """
    spark = refs.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    months = refs.groupBy("parent", "key", _month(F.col("t")).alias("month")).agg(F.lit(1).alias("one")).drop("one")
    months = stage(months, "orphans")
    recs = stage(recs, "records")

    # the dictionary: a range by hash, a place by order in the range
    of_key = F.pmod(F.xxhash64("parent", "key"), F.lit(ranges)).cast("int")
    keys = months.select("parent", "key").union(recs.select("parent", "key")).groupBy("parent", "key").agg(of_key.alias("range")).repartition("range")
    keys = stage(keys.selectExpr("*", "cast(row_number() over (partition by range order by parent, key) - 1 as bigint) as place"), "dictionary")

    span = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).first()
    first, last = (span.a, span.b) if span.a is not None else (0, 0)
    # spans of months from which a record is live at the beginning to which it still is at the end, one for each key and beginning, then put together where they touch
    begins = _month(F.col("arrived")) + F.when(F.col("arrived") == F.date_trunc("month", F.col("arrived")).cast("timestamp_ntz"), 0).otherwise(1)
    a, b = F.greatest(begins, F.lit(first)), F.least(_month(F.col("deleted")) - 1, F.lit(last))
    spans = recs.where((F.col("arrived") < F.col("deleted")) & (a <= b)).groupBy("parent", "key", a.alias("a")).agg(F.max(b).alias("b"))
    spans = spans.groupBy("parent", "key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s")).select("parent", "key", F.explode(_merged(F.col("s"))).alias("s"))
    turns = spans.select("parent", "key", F.explode(F.array(F.struct(F.col("s.a").alias("month"), F.lit("begins").alias("what")), F.struct((F.col("s.b") + 1).alias("month"), F.lit("ends").alias("what")))).alias("t")).select("parent", "key", "t.*").where(F.col("month") <= last)
    coded = months.where("month is not null").select("parent", "key", "month", F.lit("refs").alias("what")).unionByName(turns).join(keys, ["parent", "key"])
    bits = coded.groupBy("range", F.floor(F.col("place") / PLACES).alias("block"), "month").agg(*[F.bitmap_construct_agg(F.when(F.col("what") == w, F.col("place") % PLACES)).alias(w) for w in ("refs", "begins", "ends")])
    bits = bits.select("range", "block", "month", *[F.when(F.bitmap_count(w) > 0, F.col(w)).alias(w) for w in ("refs", "begins", "ends")])
    blocks = bits.groupBy("range", "block").agg(F.array_sort(F.collect_list(F.struct("month", "refs", "begins", "ends"))).alias("months"))
    left = blocks.mapInArrow(_surviving, "range int, place bigint, month int")
    suspects = left.join(keys, ["range", "place"]).select("parent", "key", "month")
    undated = months.where("month is null").join(recs.select("parent", "key").distinct(), ["parent", "key"], "left_anti")
    suspects = stage(suspects.unionByName(undated.select("parent", "key", "month")), "suspects")

    # for each key in question: from when to when which rows have arrived, and until when one of them lives
    rows = recs.join(suspects.select("parent", "key").distinct(), ["parent", "key"], "left_semi")
    rows = rows.withColumn("arrived", F.coalesce("arrived", F.to_timestamp_ntz(F.lit(LAST)))).groupBy("parent", "key", "arrived").agg(F.max("deleted").alias("deleted"))
    order = "over (partition by parent, key order by arrived)"
    steps = rows.selectExpr("parent", "key", "arrived as since", f"lead(arrived, 1, timestamp_ntz'{LAST}') {order} as before", f"max(deleted) {order} as until", f"row_number() {order} as n")
    ahead = steps.where("n = 1").selectExpr("parent", "key", f"timestamp_ntz'{FIRST}' as since", "since as before", "cast(null as timestamp_ntz) as until")
    steps = steps.drop("n").unionByName(ahead)

    # references to a key in question are counted, and those to a hot one spread over several tasks
    refs = refs.withColumn("month", _month(F.col("t")))
    cases = refs.join(suspects, (refs["parent"] == suspects["parent"]) & (refs["key"] == suspects["key"]) & refs["month"].eqNullSafe(suspects["month"]), "left_semi")
    cases = stage(cases.select("table_name", "ref_key", "field", "parent", "key", "t"), "cases")
    hot = cases.groupBy("parent", "key").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts")).where("parts > 1")
    cases = cases.join(hot, ["parent", "key"], "left").withColumn("part", F.pmod(F.xxhash64("ref_key", "t"), F.coalesce("parts", F.lit(1))).cast("int")).alias("r")
    s = steps.join(hot, ["parent", "key"], "left").select(*steps.columns, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")).alias("s")
    at = (F.col("r.t") >= F.col("s.since")) & (F.col("r.t") < F.col("s.before"))
    found = cases.hint("merge").join(s.hint("merge"), (F.col("r.parent") == F.col("s.parent")) & (F.col("r.key") == F.col("s.key")) & (F.col("r.part") == F.col("s.part")) & at, "left")
    kind = F.when(F.col("s.since").isNull(), "missing").when(F.col("s.until").isNull(), "late").when(F.col("s.until") <= F.col("r.t"), "deleted")
    found = found.select("r.table_name", "r.ref_key", "r.field", kind.alias("kind"), F.date_format("r.t", "yyyy-MM").alias("period"))
    return found.where("kind is not null").distinct()


def report(orphans: DataFrame) -> DataFrame:
    """Their number by table, field, kind and month of arrival."""
    return orphans.groupBy("table_name", "field", "kind", "period").agg(F.count("*").alias("n_orphans"))
