"""Problem 3: the ids of one person or place under whose names were typed differently, by merge and rematch.

Every spelling is read into parts (given name, initials, surname; town and kind of place) and is a profile of
its own. Profiles that share a blocking key are compared; those that match are merged, which unions their
spellings and initials. The richer profiles give further keys and are compared again, until nothing merges.

A profile with a well-known given name merges only with one of that name or a form of it. One with only an
initial or an unusual (mistyped) name joins a well-known one only if there is just one that it can be: which
of two relatives is meant is not guessed.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_key, collapse
from corpusloom.operators.components import connected_components
from corpusloom.session import stage

#: A word is well known if at least this part of all different names have it, and at least LEAST names: so at most 1 / KNOWN words for each place in a name.
KNOWN, LEAST = 0.001, 3
KNOWN_PLACE_WORD = 0.005
#: Ids of one entity that one task pairs with the others.
TASK_ROWS = 4096
#: A block of more profiles than this is not compared in all its pairs but by given names.
BLOCK_ROWS = 256
#: Titles, particles of surnames, words of place names that say nothing.
TITLES = frozenset("dr prof mr mrs ms miss sir dame lord lady rev hon capt col maj lt sgt gen herr frau mme mlle don dona sr jr dipl ing st".split())
PARTICLES = frozenset("de da di do dos du del della der den van von ten ter la le el al bin ibn zu zum zur af av".split())
EMPTY_WORDS = frozenset("the of at in de la le and der die das".split())
#: Short forms of given names.
SHORT_FORMS = """
abigail:abby,abbie,gail alexander:alex,xander,sasha,sandy,al amanda:mandy andrew:andy,drew anastasia:ana,stacy,nastya,asya,stasia anthony:tony,ant
benjamin:ben,benny,benji catherine:kate,cathy,katie,kathy charles:charlie,chuck,chas,carl christopher:chris,kit,topher chiara:clara daniel:dan,danny
david:dave,davy deborah:deb,debbie,debra dmitri:dima,mitya dorothy:dot,dottie,dolly,dora edward:ed,eddie,ted,ned,teddy ekaterina:katya,kate,katia
elizabeth:liz,beth,eliza,betty,lizzie,libby,bess francisco:paco,pancho,cisco,fran,frank frances:fran,fanny,frankie frederick:fred,freddie,rick,freddy
friedrich:fritz,fred,fiete gabriella:gabi,gaby,ella,gabby giuseppe:beppe,peppe,pino,beppo gregory:greg,gregor gustav:gus,gusti hakon:hauk ignacio:nacho,iggy
isabella:bella,isa,izzy,belle jacob:jake james:jim,jimmy,jamie jennifer:jen,jenny johannes:hans,hannes,jo,johan,jannes john:jack,johnny,jon joseph:joe,joey,jos
josephine:jo,josie,fifi,josy,posy jurgen:jogi katherine:kate,kathy,katie,kat,kit,kay kenneth:ken lawrence:larry,laurie,lars leonard:leo,len,lenny linnea:nea,linn
margaret:maggie,meg,peggy,greta,marge,daisy matthew:matt,matty maximilian:max,maxi michael:mike,mick,mickey,micky mikhail:misha,mischa natalie:nat,nattie,talia
nicholas:nick,nicky,nico nadia:nadja oskar:ossi,ozzie patricia:pat,patty,trish,tricia,patsy pavel:pasha peter:pete philip:phil,pip quentin:quent,quinn
raymond:ray rebecca:becky,becca,reba richard:rich,rick,dick,ricky,richie robert:bob,rob,bobby,robbie,bert samuel:sam,sammy stephen:steve,stevie,steph susan:sue,susie,suzy
theodore:ted,theo,teddy,teo thomas:tom,tommy timothy:tim,timmy victoria:vicky,vic,tori,vicki vincent:vince,vinny,vin walter:walt,wally,wat william:will,bill,billy,liam,willy
xenia:xen,ksenia yusuf:yus,jusuf zachary:zach,zack,zac
"""
_FORMS: dict[str, set[str]] = {}
for _entry in SHORT_FORMS.split():
    _full, _, _short = _entry.partition(":")
    for _form in _short.split(","):
        _FORMS.setdefault(_form, set()).add(_full)


def fold(name: str) -> str:
    """Without accents, and letters that only look joined apart."""
    name = name.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae").replace("’", "'").replace("ʼ", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def within_one(a: str, b: str) -> bool:
    """Equal but for one letter added, left out, changed, or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _parts(name: str) -> list[list[str]]:
    """The words of a name, each as its parts between hyphens; a comma is a word of its own."""
    name = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{3})", " ", fold(name)) if not re.search(r"\s", name.strip()) else fold(name)
    name = name.lower().replace("'", "").replace("_", " ").replace(",", " , ").replace(".", " ")
    words = [[p for p in w.split("-") if p] if w != "," else [","] for w in re.sub(r"[^\w\s,-]|\d", " ", name).split()]
    return [w for w in words if w]


def person(name: str, known: frozenset[str]) -> tuple[str, str, str] | None:
    """(given name or its initial, middle initials, surname) with the parts of a double surname joined by ``+``."""
    words = _parts(name)
    # a hyphen in the first word stands for a blank: in a double surname there is a given name before it
    if words and len(words[0]) > 1 and (len(words) == 1 or words[0][0] in known or any(p in PARTICLES for p in words[0])):
        words = [[p] for p in words[0]] + words[1:]
    comma = [","] in words
    if comma:
        at = words.index([","])
        words = [w for w in words[at + 1 :] if w != [","]] + words[:at]
        turned = len([w for w in words if w != [","]]) - at
    words = [w for w in words if w != [","] and not (len(w) == 1 and w[0] in TITLES)]
    plain = [w for w in words if not (len(w) == 1 and w[0] in PARTICLES)]
    if len(plain) < 2:
        return ("", "", "+".join(plain[0])) if plain else None
    if not comma and not (len(plain[0]) == 1 and (plain[0][0] in known or plain[0][0] in _FORMS)):
        last = plain[-1]
        if len(last) == 1 and (last[0] in known or (len(last[0]) == 1 and len(plain[0][0]) > 1)):
            plain = [last, *plain[:-1]]
    given, rest = plain[0], plain[1:]
    if len(given) == 1 and given[0] not in known:  # a particle that has lost its blank
        given = [next((given[0][: -len(p)] for p in PARTICLES if given[0].endswith(p) and given[0][: -len(p)] in known), given[0])]
    middle = "".join(w[0] for w in rest[:-1] if len(w) == 1 and len(w[0]) == 1)
    sur = [w for w in rest if not (len(w) == 1 and len(w[0]) == 1)] or [rest[-1]]
    if len(sur) == 1:
        surname = "+".join(sur[0])
    else:
        # a second given name, or a surname broken by a blank
        surname = "".join("".join(w) for w in sur)
    return ("".join(given), middle, surname)


def place(name: str, vocabulary: frozenset[str]) -> tuple[str, tuple[str, ...]] | None:
    """(town, words for the kind of place)."""
    words = [p for w in _parts(re.sub(r"['’]s\b", "", name)) if w != [","] for p in w if p not in EMPTY_WORDS]
    town = [w for w in words if w not in vocabulary and len(w) >= 5 and not any(_abbreviates(w, v) for v in vocabulary)]
    if not town:
        rest = sorted((w for w in words if w not in vocabulary), key=len)
        town = rest[-1:]
    kind = tuple(w for w in words if w not in town)
    return ("".join(town), kind) if town else None


def _abbreviates(short: str, full: str) -> bool:
    """The same first letter, and the others in order; or the same word mistyped."""
    if short[:1] != full[:1]:
        return False
    if len(short) < len(full):
        rest = iter(full)
        if all(c in rest for c in short):
            return True
    if len(short) >= 4 and within_one(short, full):
        return True
    return len(short) == len(full) >= 6 and sum(a != b for a, b in zip(short, full)) <= 2


def spelling(kind: str, name: str, known: frozenset[str], vocabulary: frozenset[str]) -> str | None:
    """A name in its parts: ``p|given|middle|surname`` or ``v|town|kind of place``; null for one without letters."""
    if kind == "p":
        parts = person(name, known)
        return parts and "p|" + "|".join(parts)
    parts = place(name, vocabulary)
    return parts and f"v|{parts[0]}|{' '.join(sorted(parts[1]))}"


def _shorter(word: str) -> set[str]:
    return {word} | ({word[:k] + word[k + 1 :] for k in range(len(word))} if len(word) > 4 else set())


def block_keys(spellings: list[str]) -> set[str]:
    """Keys of a profile: of all its surnames (or towns) with one letter left out or none, each with all its initials."""
    keys: set[str] = set()
    if spellings[0][0] == "p":
        parts = [s.split("|") for s in spellings]
        surnames = {x for p in parts for x in (*p[3].split("+"), p[3].replace("+", ""))}
        givens = {p[1] for p in parts}
        initials = {g[:1] for g in givens} | {f[:1] for g in givens for f in _FORMS.get(g, ())}
        for s in surnames:
            keys |= {f"p{d}|{i}" for d in _shorter(s) for i in initials}
            # a first letter of the given name mistyped, of the same surname
            keys |= {f"q{s}|{d}" for g in givens if len(g) > 4 for d in _shorter(g)}
    else:
        for s in spellings:
            _, town, kind = s.split("|")
            words = kind.split()
            letters = {"".join(sorted(w[0] for w in words))}
            if len(words) == 1 and len(words[0]) <= 4:
                letters |= {"".join(sorted(words[0])), "".join(sorted(words[0][1:]))}
            letters |= {"".join(sorted(w[0] for w in words if w != "national" and w != "natl"))}
            keys |= {f"v{d}|{x}" for d in _shorter(town) for x in letters}
    return keys


def _same_given(a: str, b: str, known: frozenset[str]) -> int:
    """3: the same or a form of it; 2: mistyped; 1: an initial; 0: another name."""
    if not a or not b:
        return 0
    if a == b:
        return 3 if len(a) > 1 else 1
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return 1 if other[0] == one or any(f[0] == one for f in _FORMS.get(other, ())) else 0
    if ({a} | _FORMS.get(a, set())) & ({b} | _FORMS.get(b, set())):
        return 3
    if a in known and b in known:
        return 0
    if min(len(a), len(b)) >= 3 and within_one(a, b):
        return 2
    # mistyped short forms
    short, full = sorted((a, b), key=len)
    return 2 if len(short) >= 3 and full.startswith(short) and short not in known else 0


def given_keys(spellings: list[str]) -> set[tuple[str, int, int]]:
    """Keys of the given names of a person's profile, with the side that it takes and the side that it looks for.

    Whatever ``_same_given`` holds for the same name in some way meets: the same names, forms and names with one
    letter mistyped on side 0, initials (1) with names that may stand behind them (2), shortened names (1) with
    longer ones (2).
    """
    keys: set[tuple[str, int, int]] = set()
    for g in {s.split("|")[1] for s in spellings} - {""}:
        keys |= {(f"={f}", 0, 0) for f in {g} | _FORMS.get(g, set())}
        if len(g) == 1:
            keys.add((f"i{g}", 1, 2))
            continue
        keys |= {(f"i{f[0]}", 2, 1) for f in {g} | _FORMS.get(g, set())}
        if len(g) > 2:
            keys |= {(f"-{d}", 0, 0) for d in {g} | {g[:k] + g[k + 1 :] for k in range(len(g))}}
            keys.add((f"<{g}", 1, 2))
            keys |= {(f"<{g[:k]}", 2, 1) for k in range(3, len(g))}
    return keys


def _same_surname(a: str, b: str) -> int:
    """2: the same, or one of a double one; 1: mistyped; 0: another."""
    if a.replace("+", "") == b.replace("+", ""):
        return 2
    first, second = a.split("+"), b.split("+")
    if (len(first) > 1) != (len(second) > 1) and set(first) & set(second):
        return 2
    joined = (a.replace("+", ""), b.replace("+", ""))
    if min(map(len, joined)) >= 5 and within_one(*joined):
        return 1
    if (len(first) > 1) != (len(second) > 1) and any(min(len(x), len(y)) >= 6 and within_one(x, y) for x in first for y in second):
        return 1
    return 0


def _same_kind(a: str, b: str) -> int:
    """2: the same words, some perhaps shortened; 1: one by its initials; 0: another kind of place."""
    x, y = a.split(), b.split()
    # a national stadium is the town's stadium
    if len(x) != len(y) and min(len(x), len(y)):
        x, y = ([w for w in k if not _abbreviates(w, "national")] or k for k in (x, y))
    if len(x) == len(y):
        left = list(y)
        for word in x:
            hit = next((w for w in left if w == word), None) or next((w for w in left if _abbreviates(w, word) or _abbreviates(word, w)), None)
            if hit is None:
                break
            left.remove(hit)
        else:
            return 2 if all(len(w) > 1 for w in x + y) else 1
    for short, full in ((a.split(), b.split()), (b.split(), a.split())):
        if len(short) == 1 and 2 <= len(short[0]) <= 4 and len(full) >= 2:
            letters = sorted(w[0] for w in full)
            if sorted(short[0]) == letters or sorted(short[0][1:]) == letters:
                return 1
    return 0


def compare(a: list[str], b: list[str], known: frozenset[str], agree: int) -> int:
    """3: to be merged; 2: ``a`` may be ``b`` (a well-known one); -2: ``b`` may be ``a``; 1: may be the same, neither is well known; 0: others.

    ``agree``: the attributes in which they agree less those in which they differ.
    """
    if a[0][0] != b[0][0]:
        return 0
    if a[0][0] == "v":
        best = 0
        for s in a:
            for t in b:
                _, town, kind = s.split("|")
                _, other, kind_b = t.split("|")
                if town == other or (min(len(town), len(other)) >= 6 and within_one(town, other)):
                    same = _same_kind(kind, kind_b)
                    best = max(best, 3 if same == 2 else same)
        if best == 1:
            acronym = [any(len(s.split("|")[2].split()) >= 2 and all(len(w) > 1 for w in s.split("|")[2].split()) for s in p) for p in (a, b)]
            return 1 if acronym[0] == acronym[1] else (-2 if acronym[0] else 2)
        return best
    pa, pb = [s.split("|") for s in a], [s.split("|") for s in b]
    middles = [{m for p in x for m in p[2]} for x in (pa, pb)]
    if middles[0] and middles[1] and not middles[0] & middles[1]:
        return 0
    full = [{p[1] for p in x if p[1] in known or _FORMS.get(p[1], set()) & known} for x in (pa, pb)]
    if full[0] and full[1] and not any(_same_given(g, h, known) == 3 for g in full[0] for h in full[1]):
        return 0
    best = (0, 0)
    for p in pa:
        for q in pb:
            given, surname = _same_given(p[1], q[1], known), _same_surname(p[3], q[3])
            if given and surname:
                best = max(best, (given, surname))
    given, surname = best
    if not given or (agree < 0 and (given < 3 or surname < 2)):
        return 0
    if given == 3:
        return 3
    if full[0] and not full[1]:
        return -2
    if full[1] and not full[0]:
        return 2
    return 1


def _attributes(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Of each spelling the attributes with one value only, as ``key=value``."""
    rows = entities.where("attributes is not null").select("id", F.explode("attributes").alias("k", "v")).where("v is not null")
    rows = rows.groupBy("id", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo = hi")
    rows = names.join(rows, "id").groupBy("spelling", "k").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi")).where("lo = hi")
    return rows.groupBy("spelling").agg(F.collect_set(F.concat_ws("=", "k", "lo")).alias("attrs"))


def _well_known(words: DataFrame, part: float) -> frozenset[str]:
    """The words (one row for each word and name) of many names: at most 1 / part of them for each word of a name, whatever the table's size."""
    names = words.agg(F.countDistinct("name")).first()[0]
    return frozenset(r.word for r in words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST, part * names)).select("word").collect())


def _met(new: DataFrame, known: DataFrame, profiles: DataFrame, block_rows: int) -> DataFrame:
    """Pairs (``a`` < ``b``) of profiles that may match: one of ``new`` and one of ``known`` (``key``, ``profile``) under the same key.

    A key of more than ``block_rows`` profiles meets by key and given name together, so that a surname that
    many people have makes no more pairs than there are people of like given names.
    """
    large = stage(known.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("key"), "large")

    def given(frames):
        for frame in frames:
            out = []
            for k, p, s in zip(frame["key"], frame["profile"], frame["spellings"]):
                out += [(k, p, *g) for g in (given_keys(list(s)) if s[0][0] == "p" else {("", 0, 0)})]
            yield pd.DataFrame(out, columns=["key", "profile", "given", "side", "other"])

    def refined(keys):
        rows = keys.join(large, "key", "left_semi").join(profiles.select("profile", "spellings"), "profile")
        return rows.select("key", "profile", "spellings").mapInPandas(given, "key bigint, profile string, given string, side int, other int")

    def pairs(left, right, on):
        # a profile has many keys: what is small under them is no small side of a join
        met = left.withColumnRenamed("profile", "x").hint("merge").join(right.withColumnRenamed("profile", "y").hint("merge"), on).where("x <> y")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    if large.isEmpty():
        return pairs(new, known, "key").distinct()
    few = pairs(new.join(large, "key", "left_anti"), known.join(large, "key", "left_anti"), "key")
    left = refined(new).select(F.xxhash64("key", "given", "side").alias("key"), "profile")
    right = refined(known).select(F.xxhash64("key", "given", "other").alias("key"), "profile")
    return few.unionByName(pairs(left, right, "key")).distinct()


def resolve(entities: DataFrame, kinds: dict[str, str], most_rounds: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id`` and ``entity`` (a number for each person or place) of all ids whose type is in ``kinds`` (type: ``p`` person, ``v`` place).

    Rows of all times count, withdrawn ones too. Types are compared stripped and in lower case; an id without
    one has that which most ids with the same beginning (up to the hyphen) have. Null and blank names say
    nothing; an id that has no other name is left out. An id under several names links them. Empty tables
    give no rows. Rounds go on until nothing merges; if more than ``most_rounds`` have merges, that is an error.
    """
    spark = entities.sparkSession
    rows = entities.select("id", collapse("name").alias("name"), clean_key("type").alias("type")).where("id is not null")
    typed = rows.groupBy("id").agg(F.min("type").alias("type"))
    head = F.substring_index("id", "-", 1)
    guess = typed.where("type is not null").groupBy(head.alias("head"), "type").agg(F.count("*").alias("n")).groupBy("head").agg(F.max_by("type", F.struct("n", "type")).alias("guess"))
    typed = typed.withColumn("head", head).join(guess, "head", "left").select("id", F.coalesce("type", "guess").alias("type")).where(F.col("type").isin(list(kinds)))
    names = rows.where("name <> ''").select("id", "name").distinct().join(typed, "id").withColumn("kind", F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("type")])
    names = stage(names.select("id", "name", "kind"), "names")

    plain = F.lower(F.regexp_replace("name", r"[._-]", " "))
    people = names.where("kind = 'p'").select("name", F.filter(F.split(plain, r"[\s,]+"), lambda w: ~w.isin(list(TITLES)) & (F.length(w) > 1)).alias("w")).distinct()
    first = people.where("size(w) > 1").select(F.col("name"), F.expr("w[0]").alias("word")).union(people.where("size(w) > 1 and name like '%,%'").select("name", F.element_at("w", -1))).distinct()
    known = frozenset(fold(w) for w in _well_known(first, KNOWN)) - PARTICLES
    # what a place is comes after where it is: words that are seldom the first one
    places = names.where("kind = 'v'").select("name", F.filter(F.split(plain, r"[\s,]+"), lambda w: ~w.isin(list(EMPTY_WORDS)) & (F.length(w) > 3)).alias("w")).distinct()
    placed = places.select("name", F.posexplode("w").alias("at", "word"))
    later = placed.groupBy("word").agg(F.count_if(F.col("at") == 0).alias("first"), F.count_if(F.col("at") > 0).alias("later")).where("later > first")
    vocabulary = frozenset(fold(w).replace("'", "") for w in _well_known(placed.join(later, "word", "left_semi"), KNOWN_PLACE_WORD))

    def read(frames):
        for frame in frames:
            frame["spelling"] = [spelling(k, n, known, vocabulary) for k, n in zip(frame["kind"], frame["name"])]
            yield frame[["id", "spelling"]]

    kind = entities.schema["id"].dataType.simpleString()
    spelled = stage(names.mapInPandas(read, f"id {kind}, spelling string").where("spelling is not null").distinct(), "spelled")

    # a profile for each spelling; an id that has several links them
    several = spelled.groupBy("id").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b"), F.count("*").alias("n")).where("n > 1")
    links = spelled.join(several.select("id", "a"), "id").where("spelling <> a").select("a", F.col("spelling").alias("b")).distinct()
    of = stage(spelled.select("spelling").distinct().join(connected_components(links).withColumnRenamed("node", "spelling"), "spelling", "left").select("spelling", F.coalesce("component", "spelling").alias("profile")), "profiles")
    attributes = stage(_attributes(entities, spelled), "attributes")
    changed, known_keys, known_matches = None, None, None
    for done in count():
        profiles = of.join(attributes, "spelling", "left").groupBy("profile").agg(F.collect_set("spelling").alias("spellings"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("attrs", F.array().cast("array<string>"))))).alias("attrs"))
        profiles = stage(profiles, "round")

        def keys(frames):
            for frame in frames:
                out = [(k, p) for p, s in zip(frame["profile"], frame["spellings"]) for k in block_keys(list(s))]
                yield pd.DataFrame(out, columns=["key", "profile"])

        # only profiles that a merge has changed are blocked and compared again
        new = profiles if changed is None else profiles.join(changed, "profile", "left_semi")
        new_keys = stage(new.select("profile", "spellings").mapInPandas(keys, "key string, profile string").select(F.xxhash64("key").alias("key"), "profile"), "keys")
        all_keys = new_keys if changed is None else stage(known_keys.join(touched, "profile", "left_anti").unionByName(new_keys), "keys")
        pairs = _met(new_keys, all_keys, profiles, block_rows)
        left, right = (profiles.select(F.col("profile").alias(x), F.col("spellings").alias(f"s{x}"), F.col("attrs").alias(f"t{x}")) for x in "ab")

        def match(frames):
            for frame in frames:
                found = []
                for a, b, sa, sb, ta, tb in zip(frame["a"], frame["b"], frame["sa"], frame["sb"], frame["ta"], frame["tb"]):
                    one, two = ({k: {x.partition("=")[2] for x in t if x.partition("=")[0] == k} for k in {x.partition("=")[0] for x in t}} for t in (ta, tb))
                    agree = sum(1 if one[k] & two[k] else -1 for k in one.keys() & two.keys())
                    how = compare(list(sa), list(sb), known, agree)
                    if how == -2:
                        found.append((b, a, 2, agree))
                    elif how:
                        found.append((a, b, how, agree))
                yield pd.DataFrame(found, columns=["a", "b", "how", "agree"])

        matched = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "ta", "tb").mapInPandas(match, "a string, b string, how int, agree int")
        if changed is not None:
            kept = known_matches.join(touched.withColumnRenamed("profile", "a"), "a", "left_anti").join(touched.withColumnRenamed("profile", "b"), "b", "left_anti")
            matched = matched.unionByName(kept.select("a", "b", "how", "agree"))
        matched = stage(matched, "matched")
        # one that may be a well-known one is, if there is just one, or just one that agrees with it
        may = matched.where("how = 2")
        one = may.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.count_if(F.col("agree") > 0).alias("m"), F.min(F.when(F.col("agree") > 0, F.col("b"))).alias("c"))
        sure = one.where("n = 1 or m = 1").select("a", F.when(F.col("n") == 1, F.col("b")).otherwise(F.col("c")).alias("b"))
        loose = matched.where("how = 1").join(may.select("a").distinct(), "a", "left_anti").join(may.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("a", "b")
        strong = matched.where("how = 3").select("a", "b")
        # what is sure first: others may find just one afterwards
        edges = stage(strong if not strong.isEmpty() else sure.unionByName(loose), "links")
        if edges.isEmpty():
            break
        if most_rounds is not None and done >= most_rounds:
            raise RuntimeError(f"names still merge after {most_rounds} rounds")
        merged = stage(connected_components(edges).withColumnsRenamed({"node": "profile", "component": "into"}), "merged")
        touched, changed = merged.select("profile"), merged.select(F.col("into").alias("profile")).distinct()
        known_keys, known_matches = all_keys, matched
        of = stage(of.join(merged, "profile", "left").select("spelling", F.coalesce("into", "profile").alias("profile")), "profiles")
    return spelled.join(of, "spelling").select("id", F.xxhash64("profile").alias("entity")).distinct()


def id_pairs(resolved: DataFrame) -> DataFrame:
    """All pairs of ids of one entity, the smaller first; the ids of a large entity are dealt out to as many tasks as TASK_ROWS goes into their number."""
    sizes = resolved.groupBy("entity").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = resolved.join(sizes, "entity")
    left = rows.select("entity", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = rows.select("entity", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.hint("merge").join(right.hint("merge"), ["entity", "part"]).where("id_a < id_b").select("id_a", "id_b").distinct()
