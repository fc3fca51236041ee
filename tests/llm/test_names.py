import datetime as dt
import itertools

import pytest
from hypothesis import example, given
from hypothesis import strategies as st

from corpusloom.llm import names

KNOWN = frozenset("maria mario peter petra alexander hana jana ines quentin frederick".split())


@pytest.mark.parametrize("name,want", [("Peter Aldmann", ("peter", "", "aldmann")), ("Aldmann, Peter J.", ("peter", "j", "aldmann")), ("ALDMANN Peter", ("peter", "", "aldmann")), ("Dr. Peter von Aldmann", ("peter", "", "aldmann")), ("PeterAldmann", ("peter", "", "aldmann")), ("P.Aldmann", ("p", "", "aldmann")), ("Aldmann, P.", ("p", "", "aldmann")), ("Inés Áldmann-Osterhold", ("ines", "", "aldmann+osterhold")), ("Peter Ald mann", ("peter", "", "aldmann")), ("Peter_Aldmann", ("peter", "", "aldmann")), ("Peter-Aldmann", ("peter", "", "aldmann"))])
def test_person(name, want):
    assert names.person(name, KNOWN) == want


def test_within_one():
    assert all(names.within_one(a, b) for a, b in [("abc", "abc"), ("abc", "ab"), ("abc", "abxc"), ("abc", "axc"), ("abc", "acb")])
    assert not any(names.within_one(a, b) for a, b in [("abc", "a"), ("abcd", "badc"), ("abc", "xyc")])


def rows_of(groups, kind):
    return [(f"{kind[:3].lower()}-{k}-{j}", n, kind) for k, g in enumerate(groups) for j, n in enumerate(g)]


PEOPLE = [
    ["Alexander Moraldbisk", "Xander Moraldbisk", "MORALDBISK Alexander", "A. Moraldbisk", "Alexander Moraldbsik", "Alexándér  Moraldbisk", "Capt. Alexander K. Moraldbisk"],
    ["Hana Moraldbisk"],
    ["Jana Moraldbisk"],
    ["Petra Wesungbotin", "Wesungbotin, Petra", "Petra Wesungbotin-Kalorek"],
    ["Peter Wesungbotin"],
    ["Quentin Zelinktawen", "Quentin Zelin ktawen", "Q Zelinktawen"],
]
PLACES = [
    ["Aldinksocombe Regatta Course", "ARC Aldinksocombe", "the Aldinksocombe Regattas Course."],
    ["Aldinksocombe Tennis Centre", "ALDINKSOCOMBE TENNIS CTR"],
    ["Oakursurick Fencing Federation", "Oakursurick Fed. of Fencing"],
    ["Peniterick National Velodrome", "PNV Peniterick", "Penitrick Velodrome"],
    *[[f"{t} {k}"] for t, k in [("Harbourgate", "Regatta Course"), ("Millstonefield", "Regatta Course"), ("Norwalde", "Tennis Centre"), ("Ostermoor", "Tennis Centre"), ("Quillfort", "Fencing Federation"), ("Rosenfels", "Fencing Federation"), ("Sandovale", "National Velodrome"), ("Thornwick", "National Velodrome")]],
]


def test_resolution(spark):
    filler = [[f"{g.title()} {s}"] for g in KNOWN for s in ("Kraunkgorev", "Lenovstad", "Harimnik")]
    rows = rows_of(PEOPLE + filler, "Athlete") + rows_of(PLACES, "venue ")
    rows = [(*r, {"noc": "X"}, dt.datetime(2025, 1, 1), None, "z") for r in rows]
    rows += [("ath-0-0", None, None, None, None, None, "z"), ("ath-0-0", "Alexander Moraldbisk", None, None, None, None, "z"), ("ath-n", None, "Athlete", None, None, None, "z"), ("ath-b", "  ", "Athlete", None, None, None, "z"), ("eve-1", "Peter Wesungbotin", "Event", None, None, None, "z"), (None, "Peter", "Athlete", None, None, None, "z")]
    df = spark.createDataFrame(rows, "id string, name string, type string, attributes map<string,string>, extracted_at timestamp_ntz, deleted_at timestamp_ntz, entity string")
    got = {(r.id_a, r.id_b) for r in names.id_pairs(names.resolve(df, {"athlete": "p", "venue": "v"})).collect()}
    want = set()
    for groups, kind in ((PEOPLE, "ath"), (PLACES, "ven")):
        for k, g in enumerate(groups):
            want |= {(f"{kind}-{k}-{i}", f"{kind}-{k}-{j}") for j in range(len(g)) for i in range(j)}
    assert got == {(min(p), max(p)) for p in want}
    # blocks are compared by given names as well, to the same result
    assert got == {(r.id_a, r.id_b) for r in names.id_pairs(names.resolve(df, {"athlete": "p", "venue": "v"}, block_rows=1)).collect()}


@given(st.text("abj", max_size=5), st.text("abj", max_size=5))
@example("peter", "pete")
@example("alexander", "s")
@example("xander", "sasha")
@example("quentin", "quen")
def test_like_given_names_meet(a, b):
    if names._same_given(a, b, KNOWN):
        assert {(k, side) for k, side, _ in names.given_keys([f"p|{a}||x"])} & {(k, other) for k, _, other in names.given_keys([f"p|{b}||x"])}


def test_all_given_names_meet():
    words = sorted(KNOWN | set(names._FORMS) | set("abcdefgh"))
    found = {w: names.given_keys([f"p|{w}||x"]) for w in words}
    for a in words:
        for b in words:
            if names._same_given(a, b, KNOWN):
                assert {(k, s) for k, s, _ in found[a]} & {(k, o) for k, _, o in found[b]}, (a, b)


def test_surname_of_a_third_of_all(spark):
    givens = ["".join(w) for w in itertools.product("bdg", "aeo", "lmn", "aio", "rst")]
    rows = [(f"ath-{k}-{j}", f"{g.title()}{x} Wesungbotin", "Athlete", None) for k, g in enumerate(givens) for j, x in enumerate(("", "k"))]
    df = spark.createDataFrame(rows, "id string, name string, type string, attributes map<string,string>")
    results = [{(r.id_a, r.id_b) for r in names.id_pairs(names.resolve(df, {"athlete": "p"}, block_rows=n)).collect()} for n in (10, 10**6)]
    assert results[0] == results[1]


def test_empty(spark):
    df = spark.createDataFrame([], "id string, name string, type string, attributes map<string,string>")
    assert names.resolve(df, {"athlete": "p"}).count() == 0


def test_merges_are_not_cut_short(spark):
    df = spark.createDataFrame([(f"ath-{k}-{j}", n, "Athlete", None) for k, g in enumerate(PEOPLE) for j, n in enumerate(g)], "id string, name string, type string, attributes map<string,string>")
    with pytest.raises(RuntimeError):
        names.resolve(df, {"athlete": "p"}, most_rounds=0)
