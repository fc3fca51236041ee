"""Chunking against a plain model written from the rules, and the cases that the tables lack."""

import random
import re

from corpusloom.operators import chunking
from corpusloom.schemas import SECTION_NAMES


def tokens(text):
    return max(1, int(len(text.split()) * 1.3)) if text else 0


def packed(items, limit, sep):
    out, sizes = [], []
    for x in items:
        if out and sizes[-1] + tokens(x) <= limit:
            out[-1].append(x)
            sizes[-1] += tokens(x)
        else:
            out.append([x])
            sizes.append(tokens(x))
    return [sep.join(g) for g in out]


def row(line):
    return line.count("|") >= 2 or "!!" in line


def model(doc_id, text):
    box, body, state = [], [], "before"
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text or ""):
        s = line.strip()
        if state == "before" and s.startswith("[Infobox"):
            state = "in"
        if state == "in":
            if not s:
                continue
            if line.startswith("  ") or s.startswith("[Infobox"):
                box.append(s)
                continue
            state = "after"
        body.append(line)
    sections = [["introduction", []]]
    for line in body:
        s = line.strip()
        if s and "|" not in s and "!!" not in s and " ".join(s.lower().split()) in SECTION_NAMES:
            sections.append([s, []])
        elif s:
            sections[-1][1].append(line)
    pieces = [("infobox", "infobox", "\n".join(box))] if box else []
    for name, lines in sections:
        if not lines:
            continue
        rows = sum(row(x.strip()) for x in lines)
        if rows >= 2 or (rows and any("Results table" in x for x in lines)):
            pieces += [("table", name, p.strip()) for p in packed([x.rstrip() for x in lines], 800, "\n")]
            continue
        whole = "\n".join(lines).strip()
        if tokens(whole) <= 800:
            parts = [whole]
        else:
            parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\[])", whole) if s.strip()]
            words = whole.split()
            parts = packed(parts, 800, " ") if len(parts) > 1 else [" ".join(words[k : k + 308]) for k in range(0, len(words), 308)]
        pieces += [("text", name, p.strip()) for p in packed(parts, 800, "\n\n")]
    if len(pieces) > 1 and sum(tokens(p[2]) for p in pieces) > 400:
        out, k = [], 0
        while k < len(pieces):
            kind, name, body_text = pieces[k]
            n = tokens(body_text)
            after = pieces[k + 1] if k + 1 < len(pieces) else None
            if kind == "infobox" or n >= 50:
                out.append(pieces[k])
            elif after and after[0] == kind and n + tokens(after[2]) <= 800:
                out.append((kind, name if name == after[1] else f"{name} + {after[1]}", body_text + "\n\n" + after[2]))
                k += 1
            elif out and out[-1][0] == kind and tokens(out[-1][2]) + n <= 800:
                last = out.pop()
                out.append((kind, last[1] if last[1] == name else f"{last[1]} + {name}", last[2] + "\n\n" + body_text))
            else:
                out.append(pieces[k])
            k += 1
        pieces = out
    return [(f"{doc_id}_infobox" if p[0] == "infobox" else f"{doc_id}_chunk_{k:04d}", k, *p) for k, p in enumerate(pieces)]


def random_text(rng):
    words = lambda n: " ".join(rng.choice(["Gold", "silver", "1984", "race,", "won.", "final", "the", "[note]"]) for _ in range(n))
    lines = []
    for _ in range(rng.randint(0, 25)):
        lines.append(
            rng.choice(
                [
                    lambda: words(rng.randint(1, 12)),
                    lambda: words(rng.randint(100, 900)),
                    lambda: "w " * rng.randint(600, 1700),
                    lambda: f"{words(2)} | {words(1)} | {words(3)}",
                    lambda: f"{words(1)} !! {words(40)}",
                    lambda: rng.choice(["Results", "results table", "  Early   Life ", "History", "Results table", "Final:"]),
                    lambda: "[Infobox games]",
                    lambda: "  key: " + words(2),
                    lambda: rng.choice(["", "   ", "\t", " "]),
                ]
            )()
        )
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_against_model(spark):
    rng = random.Random(3)
    docs = [(str(k), random_text(rng)) for k in range(150)] + [("null", None), ("empty", ""), ("blank", " \n "), ("long", "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {}
    for r in chunking.chunk_documents(df).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk_index, r.chunk_type, r.section, r.text))
        assert r.approx_tokens == tokens(r.text)
    for doc_id, text in docs:
        assert sorted(got.get(doc_id, []), key=lambda x: x[1]) == model(doc_id, text), doc_id


def test_words_without_sentences(spark):
    df = spark.createDataFrame([("d", "word " * 1000)], "doc_id string, text string")
    assert sorted(len(r.text.split()) for r in chunking.chunk_documents(df).collect()) == [384, 616]


def test_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([("d", "one two", "x", 1, "p")] * 2, "doc_id string, text string, lines string, opened int, pieces string")
    assert chunking.chunk_documents(df).count() == 2
    assert chunking.chunk_documents(df.limit(0)).count() == 0
