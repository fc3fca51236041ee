"""Questions answered and judged a table at a time: routing, candidates, counts, context, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Phrases by which a question is routed, in their order.
LOOKUP_PHRASES = ("how many nations competed", "how many athletes competed", "how many competitors")
COUNT_PHRASES = ("how many events", "how many biathlon events", "how many athletics events", "how many shooting events", "how many swimming events", "how many canoeing events")
MOST_WORDS = ("highest number", "most competitors", "largest field", "most participants", "highest", "most", "largest")
TIME_WORDS = ("immediately before", "held before", "immediately after", "preceding", "following year")
HOP_WORDS = ("who won", "held at", "where was", "venue", "team", "gold medal in the event")
TYPES = ("lookup", "temporal", "multi_hop", "superlative", "aggregation")
#: Words of a question that say nothing of the document, and of a title that say nothing of the event.
STOPWORDS = ("how", "many", "nations", "competed", "event", "held", "according", "provided", "corpus", "which", "gold", "medal")
TITLE_STOPWORDS = ("athletics", "summer", "olympics", "winter", "1988", "1992", "1996", "2000", "2004", "2008", "2012", "2016", "2020", "2022")
#: How texts give numbers of competitors, and how questions give a threshold.
_KINDS = "(?:competitors|athletes|participants|nations|fencers|shooters|skiers)"
COUNT_AFTER = rf"(?i){_KINDS}\s*[:=]?\s*([0-9]{{1,3}})"
COUNT_BEFORE = rf"(?i)([0-9]{{1,3}})\s+{_KINDS}"
THRESHOLD = r"(?:more than|exceeded)\s+([0-9]+)|>\s*([0-9]+)"


def _any(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def intent(question: Column) -> Column:
    q = F.lower(question)
    return F.when(_any(q, LOOKUP_PHRASES), "LOOKUP").when(_any(q, COUNT_PHRASES), "AGGREGATION").when(_any(q, MOST_WORDS), "SUPERLATIVE").when(_any(q, TIME_WORDS), "TEMPORAL").when(_any(q, HOP_WORDS), "MULTI_HOP").otherwise("LOOKUP")


def threshold(question: Column) -> Column:
    q = F.lower(question)
    return F.coalesce(*[F.nullif(F.regexp_extract(q, THRESHOLD, k), F.lit("")).try_cast("int") for k in (1, 2)])


def years(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^(19|20)[0-9][0-9]$"))


def questions_once(questions: DataFrame) -> DataFrame:
    """One row for each qid: the question asked first, its type cleaned, its answers and documents."""
    rows = questions.where("qid is not null")
    best = rows.groupBy("qid").agg(F.min_by(F.struct("question", "qtype", "answer", "gold_doc_ids"), F.struct("created_at", "question", "qtype")).alias("r"))
    return best.select("qid", "r.question", F.lower(F.trim("r.qtype")).alias("qtype"), "r.answer", "r.gold_doc_ids")


def route(questions: DataFrame) -> DataFrame:
    """qid, intent (by the given type if it is one), routed (by the text alone), year, threshold."""
    q = F.coalesce("question", F.lit(""))
    given = F.when(F.col("qtype").isin(*TYPES), F.upper("qtype"))
    return questions.select("qid", F.coalesce(given, intent(q)).alias("intent"), intent(q).alias("routed"), F.try_element_at(years(q), F.lit(1)).cast("int").alias("year"), threshold(q).alias("threshold"))


def _asked(questions: DataFrame) -> DataFrame:
    q = F.lower("question")
    terms = F.filter(F.split(q, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    women = q.contains("women") | q.contains("female")
    # a word with "men" in it counts as men, also "women"
    men = q.contains("men") | (q.contains("male") & ~women)
    return questions.where("question is not null").select("qid", terms.alias("terms"), F.array_distinct(years(F.col("question"))).alias("years"), women.alias("women"), men.alias("men"))


def _trigrams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda k: F.substr(c, k, F.lit(3))))


def _sharing_titles(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """qid and doc_id of the titles that have one of a question's terms, or the words by which the sexes are told, as a part.

    Each different term is looked up under that of its trigrams that fewest titles have; what is found there is compared.
    """
    sexes = F.concat(F.when(F.col("women"), F.array(F.lit("women"), F.lit("female"))).otherwise(F.array().cast("array<string>")), F.when(F.col("men"), F.array(F.lit("men"))).otherwise(F.array().cast("array<string>")))
    probes = asked.select("qid", F.explode(F.array_distinct(F.concat("terms", sexes))).alias("probe")).distinct()
    grams = titles.select("doc_id", "title", F.explode(_trigrams(F.col("title"))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count("*").alias("df"))
    parts = probes.select("probe").distinct().select("probe", F.explode(_trigrams(F.col("probe"))).alias("gram"))
    # a term of which some trigram is in no title is in no title
    keys = parts.join(counted, "gram", "left").groupBy("probe").agg(F.count_if(F.col("df").isNull()).alias("lacking"), F.min_by("gram", F.struct("df", "gram")).alias("gram")).where("lacking = 0")
    found = grams.join(keys.select("probe", "gram"), "gram").where(F.col("title").contains(F.col("probe"))).select("probe", "doc_id").distinct()
    return probes.join(found, "probe").select("qid", "doc_id").distinct()


def _with_titles(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Every question with the documents whose title has one of its years; one without a year with those whose title shares a term with it. No other title has a score."""
    asked = _asked(questions)
    windows = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("title") - 3, F.lit(1))), lambda k: F.col("title").substr(k, F.lit(4))), lambda w: w.rlike("^(19|20)[0-9][0-9]$")))
    titles = docs.where("title <> ''").select("doc_id", F.lower("title").alias("title"))
    # distinct terms and years first: then AQE sees the size of what the titles are joined with
    years_asked = asked.select("qid", F.explode("years").alias("y")).distinct()
    dated = years_asked.join(titles.select("doc_id", F.explode(windows).alias("y")), "y").select("qid", "doc_id").distinct()
    undated = _sharing_titles(asked.where("size(years) = 0"), titles)
    return dated.unionByName(undated).join(asked, "qid").join(titles, "doc_id")


def _holding(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word and term of the words that have a term as a part, by the trigram of the term that fewest words have."""
    grams = words.select("word", F.explode(_trigrams(F.col("word"))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count("*").alias("df"))
    parts = terms.select("term", F.explode(_trigrams(F.col("term"))).alias("gram"))
    keys = parts.join(counted, "gram", "left").groupBy("term").agg(F.count_if(F.col("df").isNull()).alias("lacking"), F.min_by("gram", F.struct("df", "gram")).alias("gram")).where("lacking = 0")
    return grams.join(keys.select("term", "gram"), "gram").where(F.col("word").contains(F.col("term"))).select("word", "term").distinct()


def candidates(questions: DataFrame, docs: DataFrame, most: int = 15) -> DataFrame:
    """qid, doc_id, score, rank: documents by the question's terms in their title, two for each, and five for or against by whose event it is."""
    rows = _with_titles(questions, docs)
    t = F.col("title")
    hits = F.size(F.filter("terms", lambda w: t.contains(w))) * 2
    about_women, about_men = t.contains("women"), t.contains("men") & ~t.contains("women")
    for_women = F.when(F.col("women") & (about_women | t.contains("female")), 5).when(F.col("women") & about_men, -5).otherwise(0)
    for_men = F.when(F.col("men") & about_men, 5).when(F.col("men") & about_women, -5).otherwise(0)
    scored = rows.select("qid", "doc_id", (hits + for_women + for_men).alias("score")).where("score > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def candidates_by_text(questions: DataFrame, docs: DataFrame, most: int = 15) -> DataFrame:
    """As :func:`candidates`: three for each term in the title and one for each in the document's text."""
    asked = _asked(questions)
    titled = _with_titles(questions.where(F.size(F.array_distinct(years(F.col("question")))) > 0), docs).select("qid", "doc_id", "terms", "title")
    # a question without a year may find its terms in any text: by words that begin with or hold them
    undated = asked.where("size(years) = 0")
    titles = docs.where("title <> ''").select("doc_id", F.lower("title").alias("title"), F.lower("text").alias("text"))
    words = titles.select("doc_id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "title", "text"), r"[^\p{L}\p{N}_]+"))).alias("word")).where(F.length("word") > 2)
    terms_asked = undated.select("qid", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    vocabulary = _holding(words.select("word").distinct(), terms_asked.select("term").distinct())
    shared = words.join(vocabulary, "word").select("term", "doc_id").distinct().join(terms_asked, "term").select("qid", "doc_id").distinct()
    titled = titled.unionByName(shared.join(undated.select("qid", "terms"), "qid").join(titles.select("doc_id", "title"), "doc_id").select("qid", "doc_id", "terms", "title"))
    rows = titled.join(docs.select("doc_id", F.lower("text").alias("text")), "doc_id")
    t, x = F.col("title"), F.col("text")
    score = F.size(F.filter("terms", lambda w: t.contains(w))) * 3 + F.size(F.filter("terms", lambda w: x.contains(w)))
    scored = rows.select("qid", "doc_id", score.alias("score")).where("score > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def first_texts(docs: DataFrame, passages: DataFrame, most: int = 2) -> DataFrame:
    """doc_id, title and text of the documents that have passages, the text being their first ``most`` ones. Documents are cut to them before anything is collected."""
    kept = passages.select("doc_id", "chunk_index", "chunk_id", "text").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))).where(F.col("n") <= most)
    texts = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return docs.select("doc_id", "title").join(texts.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text")), "doc_id")


def candidates_by_passages(questions: DataFrame, passages: DataFrame, most: int = 15) -> DataFrame:
    """qid, doc_id, score, rank: for questions whose terms no title has. Over a document's passages, one for each of the question's terms in the passage, and three if it has one of its years.

    Terms and years are parts of words, so passages meet questions by their words, not each by each. Passages of no document count for none.
    """
    asked = _asked(questions).select("qid", "terms", "years")
    probes = asked.select("qid", F.explode("terms").alias("term"), F.lit(False).alias("is_year")).unionByName(asked.select("qid", F.explode("years").alias("term"), F.lit(True).alias("is_year")))
    probes = probes.groupBy("qid", "term", "is_year").agg(F.count("*").alias("times"))
    words = passages.where("doc_id is not null").select("chunk_id", "doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word")).where(F.length("word") > 2)
    holding = _holding(words.select("word").distinct(), probes.select("term").distinct())
    shared = words.join(holding, "word").select("chunk_id", "doc_id", "term").distinct().join(probes, "term")
    per = shared.groupBy("qid", "doc_id", "chunk_id").agg((F.sum(F.when(~F.col("is_year"), F.col("times")).otherwise(0)) + F.when(F.max("is_year"), 3).otherwise(0)).alias("s"))
    scored = per.groupBy("qid", "doc_id").agg(F.sum("s").alias("score")).where("score > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def competitors(passages: DataFrame) -> DataFrame:
    """doc_id and the largest number from 1 to 500 that its passages give of competitors; numbers of more digits count by their first three or last three."""
    numbers = F.concat(F.regexp_extract_all("text", F.lit(COUNT_AFTER), 1), F.regexp_extract_all("text", F.lit(COUNT_BEFORE), 1))
    most = F.array_max(F.filter(F.transform(numbers, lambda x: x.cast("int")), lambda v: v.between(1, 500)))
    return passages.select("doc_id", most.alias("n")).where("n is not null").groupBy("doc_id").agg(F.max("n").alias("competitors"))


def summaries(passages: DataFrame) -> DataFrame:
    """doc_id and one line on it: title and competitors, or the beginning of its first passage."""
    first = passages.groupBy("doc_id").agg(F.min_by(F.struct("title", "text"), F.struct("chunk_index", "chunk_id")).alias("f"))
    rows = first.join(competitors(passages), "doc_id", "left")
    details = F.substring(T.strip(F.replace(F.substring_index("f.text", ".", 1), F.lit("\n"), F.lit(" "))), 1, 150)
    title = F.coalesce("f.title", F.lit(""))
    line = F.when(F.col("competitors").isNotNull(), F.concat(F.lit("Event: "), title, F.lit(" | Total Competitors: "), F.col("competitors"))).otherwise(F.concat(F.lit("Event: "), title, F.lit(" | Details: "), details))
    return rows.select("doc_id", line.alias("summary"))


def above_threshold(questions: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Of every question with a threshold: how many of its candidates have more competitors, and of how many they are known."""
    asked = questions.select("qid", threshold(F.coalesce("question", F.lit(""))).alias("threshold")).where("threshold is not null")
    rows = asked.join(found.select("qid", "doc_id"), "qid").join(counts, "doc_id")
    return rows.groupBy("qid", "threshold").agg(F.count_if(F.col("competitors") > F.col("threshold")).alias("n_above"), F.count("*").alias("n_known"))


def largest(questions: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Of every question for a maximum the candidate with most competitors, ties to the smaller doc_id."""
    asked = route(questions).where("intent = 'SUPERLATIVE'").select("qid")
    rows = asked.join(found.select("qid", "doc_id"), "qid").join(counts, "doc_id")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("competitors"), "doc_id"))).where("n = 1")
    return best.select("qid", "doc_id", "competitors")


def gold_context(questions: DataFrame, passages: DataFrame, most: int = 8, characters: int = 8000) -> DataFrame:
    """qid, n_passages and context: the first passages of a question's own documents, in the order of these, cut to ``characters``.

    A document gives its first ``most`` passages at most, and is cut to them before the join: it may be the
    document of many questions and have many passages.
    """
    kept = passages.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))).where(F.col("n") <= most)
    asked = questions.select("qid", F.posexplode("gold_doc_ids").alias("pos", "doc_id")).groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    rows = asked.join(kept.select("doc_id", "n", "title", "text"), "doc_id")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "n"))).where(F.col("k") <= most)
    one = F.concat(F.lit("Doc ["), F.col("doc_id"), F.lit("] - "), F.coalesce("title", F.lit("")), F.lit(":\n"), F.col("text"))
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("x")))).alias("l"))
    return lists.select("qid", F.size("l").alias("n_passages"), F.substring(F.array_join(F.transform("l", lambda x: x["x"]), "\n\n"), 1, characters).alias("context"))


def plain(c: Column | str) -> Column:
    """As answers are compared: lower case, runs of white space one blank."""
    return F.lower(T.collapse(c))


def _numbers(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[0-9]+$"))


def _words(c: Column, least: int) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= least)


def matches(answer: str = "predicted_answer", truths: str = "answer", qtype: str = "qtype", version: int = 1) -> Column:
    """Whether an answer is taken for right by one of three rule sets. All go by parts of strings, so they are generous.

    1: the truth in it; three or more words of the truth; a number of it (counts and lookups); the title's words (maxima).
    2: the truth in it; any number of it; all words of three letters or more. 3: as 1 for counts and maxima only, words of four letters or more.
    """
    a, kind = plain(answer), F.coalesce(F.col(qtype), F.lit(""))

    def right(truth: Column) -> Column:
        def of(g: Column) -> Column:
            number = F.arrays_overlap(_numbers(g), _numbers(a))
            every = lambda ws: F.forall(ws, lambda w: a.contains(w))
            if version == 2:
                ws = _words(g, 3)
                return a.contains(g) | number | ((F.size(ws) > 0) & every(ws))
            ws = _words(g, 3 if version == 1 else 4)
            title = F.filter(ws, lambda w: ~w.isin(*TITLE_STOPWORDS))
            maximum = (kind == "superlative") & (F.size(title) > 0) & every(title)
            if version == 3:
                return a.contains(g) | ((kind == "aggregation") & number) | maximum
            return a.contains(g) | ((F.size(ws) >= 3) & every(ws)) | (kind.isin("aggregation", "lookup") & number) | maximum

        return T.let(plain(truth), of)

    usable = F.coalesce(T.strip(answer) != "", F.lit(False))
    if version == 1:
        usable = usable & ~F.col(answer).startswith("Failed") & ~F.col(answer).startswith("Error")
    return F.when(usable, F.coalesce(F.exists(truths, right), F.lit(False))).otherwise(F.lit(False))


def judged(predictions: DataFrame, questions: DataFrame, version: int = 1) -> DataFrame:
    """pred_id, qid, qtype, right of every prediction (the last logged row of each) whose question is known."""
    rows = predictions.where("pred_id is not null").groupBy("pred_id").agg(F.max_by(F.struct("qid", "predicted_answer"), F.struct("logged_at", "predicted_answer")).alias("p")).select("pred_id", "p.*")
    joined = rows.join(questions.select("qid", "qtype", "answer"), "qid")
    return joined.select("pred_id", "qid", "qtype", matches(version=version).alias("right"))


def accuracy(judgements: DataFrame) -> DataFrame:
    """By type and over all (a null type with ``overall``): answers, right ones, per cent."""
    rolled = judgements.rollup("qtype").agg(F.grouping("qtype").alias("overall"), F.count("*").alias("n"), F.count_if("right").alias("n_right"))
    return rolled.select("qtype", (F.col("overall") == 1).alias("overall"), "n", "n_right", F.round(F.col("n_right") * 100.0 / F.col("n"), 2).alias("percent"))


def previous_editions(entities: DataFrame) -> DataFrame:
    """series, year, previous: of every event that is held again, when it was held before."""
    parts = F.regexp_extract(T.collapse("name"), r"^(.+) at the ([0-9]{4}) .* Games [–-] (.+)$", 1)
    year = F.regexp_extract(T.collapse("name"), r"^(.+) at the ([0-9]{4}) .* Games [–-] (.+)$", 2)
    event = F.regexp_extract(T.collapse("name"), r"^(.+) at the ([0-9]{4}) .* Games [–-] (.+)$", 3)
    rows = entities.where("name is not null").select(F.concat_ws(" / ", parts, event).alias("series"), F.nullif(year, F.lit("")).cast("int").alias("year")).where("year is not null").distinct()
    return rows.select("series", "year", F.lag("year").over(Window.partitionBy("series").orderBy("year")).alias("previous"))


def next_editions(entities: DataFrame) -> DataFrame:
    """series, year, following: of every event that is held again, when it is held next."""
    rows = previous_editions(entities)
    return rows.select("series", "year", F.lead("year").over(Window.partitionBy("series").orderBy("year")).alias("following"))


def joined_summaries(found: DataFrame, lines: DataFrame, characters: int = 6000) -> DataFrame:
    """qid and context: the summaries of a question's candidates (a ranking, cut by the search) in their order, cut to ``characters``."""
    rows = found.select("qid", "doc_id", "rank").join(lines, "doc_id")
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "summary"))).alias("l"))
    return lists.select("qid", F.substring(F.array_join(F.transform("l", lambda x: x["summary"]), "\n"), 1, characters).alias("context"))


def fuse(questions: DataFrame, summarised: DataFrame, evidence: DataFrame, characters: int = 12000) -> DataFrame:
    """qid, intent and context of every question: counts and maxima take the summaries, others the evidence; cut to ``characters``, empty where there is none."""
    rows = route(questions).select("qid", "intent").join(summarised.select("qid", F.col("context").alias("s")), "qid", "left").join(evidence.select("qid", F.col("context").alias("e")), "qid", "left")
    context = F.when(F.col("intent").isin("AGGREGATION", "SUPERLATIVE"), F.col("s")).otherwise(F.col("e"))
    return rows.select("qid", "intent", F.substring(F.coalesce(context, F.lit("")), 1, characters).alias("context"))


def answered(questions: DataFrame, above: DataFrame, most: DataFrame, titles: DataFrame) -> DataFrame:
    """qid, intent, answer: the count for a threshold, the title for a maximum, else what is said where nothing is found."""
    rows = route(questions).select("qid", "intent").join(above.select("qid", "n_above"), "qid", "left").join(most.join(titles.select("doc_id", "title"), "doc_id").select("qid", "title"), "qid", "left")
    answer = F.when((F.col("intent") == "AGGREGATION") & F.col("n_above").isNotNull(), F.col("n_above").cast("string")).when((F.col("intent") == "SUPERLATIVE") & F.col("title").isNotNull(), F.col("title"))
    return rows.select("qid", "intent", F.coalesce(answer, F.lit("Failed to generate answer")).alias("answer"))
