"""Documents into chunks: box, sections, tables and prose, packed to size, small ones merged.

Everything is an expression over one row, so a corpus is chunked in a single narrow pass without a shuffle.
Folds keep positions and sizes only; texts are put together once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.schemas import MOST_TOKENS, SECTION_NAMES, SMALL_TOKENS, TARGET_TOKENS, WORDS_PER_PIECE


#: How names of sections begin, up to their first blank at most: few other lines do, and only those are looked at closely.
_BEGINNINGS = sorted({name[:3] for name in SECTION_NAMES})


def is_heading(line: Column) -> Column:
    begins = F.lower(F.substring(T.strip(line), 1, 3)).isin(*_BEGINNINGS)
    return begins & ~line.contains("|") & ~line.contains("!!") & F.lower(T.collapse(line)).isin(*SECTION_NAMES)


def _positions(items: Column, test) -> Column:
    """The 1-based positions at which ``test`` holds."""
    return F.filter(F.transform(items, lambda x, k: F.when(test(x), k + 1)), lambda k: k.isNotNull())


_NO_LINES = "array<string>"


def _also(df: DataFrame, **columns: Column) -> DataFrame:
    """With further columns, each worked out once."""
    for name, value in columns.items():
        df = df.select("*", T.once(value).alias(name))
    return df


def split_box(docs: DataFrame) -> DataFrame:
    """Adds ``box`` and ``body``, arrays of lines.

    The first line that begins with ``[Infobox`` opens the box. Blank and indented lines and further openers
    belong to it (blank ones are dropped); the first other line ends it. All other lines are the body.
    """
    opens = lambda x: T.strip(x).startswith("[Infobox")
    goes_on = lambda x: (T.strip(x) == "") | x.startswith("  ") | opens(x)
    rows = _also(docs, lines=F.coalesce(T.lines("text"), F.array().cast(_NO_LINES)))
    rows = _also(rows, opened=F.coalesce(F.try_element_at(_positions(F.col("lines"), opens), F.lit(1)), F.lit(0)))
    ends = F.filter(F.transform("lines", lambda x, k: F.when((k + 1 > F.col("opened")) & ~goes_on(x), k + 1)), lambda k: k.isNotNull())
    rows = _also(rows, closed=F.when(F.col("opened") == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(ends, F.lit(1)), F.size("lines") + 1)))
    box = F.filter(F.transform(F.slice("lines", F.greatest("opened", F.lit(1)), F.greatest(F.col("closed") - F.col("opened"), F.lit(0))), T.strip), lambda x: x != "")
    head = F.slice("lines", 1, F.greatest(F.col("opened") - 1, F.lit(0)))
    rest = F.slice("lines", F.greatest("closed", F.lit(1)), F.greatest(F.size("lines") - F.col("closed") + 1, F.lit(0)))
    body = F.when(F.col("opened") == 0, F.col("lines")).otherwise(F.concat(head, rest))
    rows = _also(rows, box=F.when(F.col("opened") > 0, box).otherwise(F.array().cast(_NO_LINES)), body=F.filter(body, lambda x: T.strip(x) != ""))
    return rows.drop("lines", "opened", "closed")


def with_sections(boxed: DataFrame) -> DataFrame:
    """Adds ``sections``: of each run of lines under a heading its name and lines. Headings without lines have none; what precedes the first is ``introduction``."""
    rows = _also(boxed, heads=F.concat(F.array(F.lit(0)), _positions(F.col("body"), lambda x: is_heading(T.strip(x)))))

    def section(head: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at(F.col("heads"), k + 2), F.size("body") + 1)
        name = F.when(head == 0, F.lit("introduction")).otherwise(T.strip(F.try_element_at(F.col("body"), F.greatest(head, F.lit(1)))))
        return F.struct(name.alias("section"), F.slice("body", head + 1, end - head - 1).alias("lines"))

    return _also(rows, sections=F.filter(F.transform("heads", section), lambda s: F.size(s["lines"]) > 0)).drop("heads")


def pack_prose(text: Column) -> Column:
    """Pieces of a text: whole if small enough, else its sentences packed, or words if it is one sentence; then pieces packed again."""

    def by_words(text: Column) -> Column:
        def cut(words: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / WORDS_PER_PIECE).cast("int")), lambda k: F.array_join(F.slice(words, k * WORDS_PER_PIECE + 1, F.lit(WORDS_PER_PIECE)), " "))

        return T.let(T.words(text), cut)

    def large(text: Column) -> Column:
        return T.let(T.sentences(text), lambda s: F.when(F.size(s) > 1, T.pack(s, MOST_TOKENS, " ")).otherwise(by_words(text)))

    return T.let(text, lambda x: F.when(T.approx_tokens(x) <= MOST_TOKENS, F.array(x)).otherwise(T.pack(large(x), MOST_TOKENS, "\n\n")))


def pack_rows(lines: Column) -> Column:
    """A table's lines packed to size."""
    return T.pack(F.transform(lines, T.strip_end), MOST_TOKENS, "\n")


def is_table(lines: Column) -> Column:
    rows = F.size(F.filter(F.transform(lines, T.strip), T.is_table_row))
    return T.let(rows, lambda n: (n >= 2) | ((n >= 1) & F.exists(lines, lambda x: x.contains("Results table"))))


def with_pieces(sectioned: DataFrame) -> DataFrame:
    """Adds ``pieces``: type, section and text in order, the box first."""

    def of(s: Column) -> Column:
        def texts(table: Column) -> Column:
            packed = F.when(table, pack_rows(s["lines"])).otherwise(pack_prose(T.strip(F.array_join(s["lines"], "\n"))))
            kind = F.when(table, F.lit("table")).otherwise(F.lit("text"))
            return F.transform(packed, lambda x: F.struct(kind.alias("type"), s["section"].alias("section"), T.strip(x).alias("text")))

        return T.let(is_table(s["lines"]), texts)

    box = F.when(F.size("box") > 0, F.array(F.struct(F.lit("infobox").alias("type"), F.lit("infobox").alias("section"), F.array_join("box", "\n").alias("text"))))
    none = F.array().cast("array<struct<type:string,section:string,text:string>>")
    return _also(sectioned, pieces=F.concat(F.coalesce(box, none), F.filter(F.flatten(F.transform("sections", of)), lambda p: p["text"] != "")))


def tokens_of(words: Column) -> Column:
    return F.when(words == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(words * F.lit(T.TOKENS_PER_WORD)).cast("int")))


_GROUP = "struct<lo:int,hi:int,type:string,section:string,path:string,words:int,tokens:int>"


def _group(lo, hi, kind, section, path, words, tokens) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), kind.alias("type"), section.alias("section"), path.alias("path"), words.cast("int").alias("words"), tokens.cast("int").alias("tokens"))


def with_groups(pieced: DataFrame) -> DataFrame:
    """Adds ``groups`` of neighbouring pieces: a small piece joins the next of its type if both fit, else the one before.

    Words add up when texts are joined, so the fold needs no text. What joined the next one is not looked at again.
    """
    words = lambda p: T.let(T.word_count(p["text"]), lambda n: F.struct(n.alias("words"), tokens_of(n).alias("tokens")))
    rows = _also(pieced, sized=F.transform("pieces", lambda p, k: T.let(words(p), lambda w: _group(k, k, p["type"], p["section"], p["section"], w["words"], w["tokens"]))))
    sized = F.col("sized")
    # of two neighbours in either order: whether they fit, and their tokens together
    fits = lambda a, b: F.coalesce((a["type"] == b["type"]) & (a["tokens"] + b["tokens"] <= MOST_TOKENS), F.lit(False))
    both = lambda a, b: F.when(a == b, a).otherwise(F.concat(a, F.lit(" + "), b))
    joined = lambda x, after: _group(x["lo"], after["hi"], x["type"], both(x["section"], after["section"]), after["path"], x["words"] + after["words"], tokens_of(x["words"] + after["words"]))
    grown = lambda before, x: _group(before["lo"], x["hi"], x["type"], both(before["section"], x["section"]), before["path"], before["words"] + x["words"], tokens_of(before["words"] + x["words"]))

    def step(acc: Column, x: Column) -> Column:
        keep = (x["type"] == "infobox") | (x["tokens"] >= SMALL_TOKENS)

        def small(near: Column) -> Column:
            out = acc["out"]
            forward = F.struct(F.concat(out, F.array(joined(x, near["after"]))).alias("out"), F.lit(True).alias("skip"))
            back = F.struct(F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown(near["before"], x))).alias("out"), F.lit(False).alias("skip"))
            alone = F.struct(F.concat(out, F.array(x)).alias("out"), F.lit(False).alias("skip"))
            return F.when(fits(x, near["after"]), forward).when(fits(near["before"], x), back).otherwise(alone)

        near = F.struct(F.try_element_at(sized, x["hi"] + 2).alias("after"), F.try_element_at(acc["out"], F.lit(-1)).alias("before"))
        skipped = F.struct(acc["out"].alias("out"), F.lit(False).alias("skip"))
        kept = F.struct(F.concat(acc["out"], F.array(x)).alias("out"), F.lit(False).alias("skip"))
        return F.when(acc["skip"], skipped).when(keep, kept).otherwise(T.let(near, small))

    start = F.struct(F.array().cast(f"array<{_GROUP}>").alias("out"), F.lit(False).alias("skip"))
    merged = F.aggregate("sized", start, step, lambda acc: acc["out"])
    total = F.aggregate("sized", F.lit(0), lambda n, x: n + x["tokens"])
    return _also(rows, groups=F.when((F.size("sized") <= 1) | (total <= TARGET_TOKENS), sized).otherwise(merged)).drop("sized")


def chunk_documents(docs: DataFrame) -> DataFrame:
    """The chunks of every document (doc_id, text): chunk_id, chunk_index, chunk_type, section, section_path, approx_tokens, text.

    Null, empty and blank texts have none; a repeated document is chunked each time. Texts are read whole.
    Columns of ``docs`` besides doc_id and text are not read.
    """
    rows = with_groups(with_pieces(with_sections(split_box(docs.select("doc_id", "text")))))
    rows = rows.select("doc_id", "pieces", F.posexplode("groups").alias("chunk_index", "g"))
    text = F.array_join(F.transform(F.slice("pieces", F.col("g.lo") + 1, F.col("g.hi") - F.col("g.lo") + 1), lambda p: p["text"]), "\n\n")
    name = F.when(F.col("g.type") == "infobox", F.concat("doc_id", F.lit("_infobox"))).otherwise(F.concat("doc_id", F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")))
    return rows.select(name.alias("chunk_id"), "doc_id", "chunk_index", F.col("g.type").alias("chunk_type"), F.col("g.section").alias("section"), F.array("g.path").alias("section_path"), F.col("g.tokens").alias("approx_tokens"), text.alias("text"))
