import random

from corpusloom.llm.splitting import cut_points, least_words, most_words, split_oversized, tokens

LIMITS = [("text", 40, 8), ("table", 30, 0), (" Infobox", 20, 5), ("text", 45, 9), (None, 1, 1), ("odd", None, 3)]


def test_words_and_tokens():
    for n in range(1, 3000):
        assert tokens(n) == int(n * 13 // 10)
        assert tokens(most_words(n)) <= n < tokens(most_words(n) + 1)
        assert tokens(least_words(n)) >= n > tokens(least_words(n) - 1)


def pieces_hold(text, limit, overlap):
    starts, ends, pieces = cut_points(text, limit, overlap)
    words, got, before = text.split(), [], 0
    assert len(starts) == len(words)
    for k, (a, b, _) in enumerate(pieces):
        assert a < b and tokens(b - a) <= limit
        if k:
            assert before - a == min(least_words(overlap), most_words(limit) - 1)
        got += words[before:b]
        before = b
    assert got == words
    return pieces


def test_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["word", "two. ", " ", "\n", "\n\n", "x! Y", " ", " a", "end.\n"]) for _ in range(rng.randint(1, 600))).strip() or "a"
        pieces_hold(text, rng.choice([1, 5, 40, 300]), rng.choice([0, 1, 8, 39, 500]))


def test_natural_boundaries():
    paragraphs = "\n\n".join(" ".join(["w"] * 20) for _ in range(10))
    assert {c for _, _, c in pieces_hold(paragraphs, 60, 5)} == {"paragraph", "end"}
    lines = "\n".join(" ".join(["w"] * 20) for _ in range(10))
    assert {c for _, _, c in pieces_hold(lines, 60, 5)} == {"line", "end"}
    sentences = " ".join("one two three four five." for _ in range(50))
    assert {c for _, _, c in pieces_hold(sentences, 60, 5)} == {"sentence", "end"}
    assert {c for _, _, c in pieces_hold("w " * 500, 60, 5)} == {"hard", "end"}


def test_spark(spark):
    rows = [("a", "text", "s", "w " * 100), ("a", "text", "s", "w " * 100), ("b", " TABLE ", None, "r | s\n" * 60), ("c", "other", "s", "w " * 999), ("d", "text", "s", None), ("e", "text", "s", ""), ("f", None, "s", "w " * 99), (None, "text", "s", "v " * 50), ("g", "text", "s", "w " * 30), ("h", "text", "s", "w " * 31), ("long", "text", "s", "w " * 60_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "chunk_id string, chunk_type string, section string, text string, piece int")
    limits = spark.createDataFrame(LIMITS, "chunk_type string, max_tokens int, overlap_tokens int")
    got = {}
    for r in split_oversized(df, limits).collect():
        assert r.n_tokens <= r.max_tokens and len(r.piece.split()) == r.end_word - r.start_word
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {"a", "b", None, "long"} | ({"h"} if tokens(31) > 40 else set())
    assert all(sorted(r.piece_index for r in rs) == list(range(rs[0].n_pieces)) for rs in got.values())
    assert split_oversized(df.limit(0), limits).count() == 0
    assert split_oversized(df, limits.limit(0)).count() == 0
