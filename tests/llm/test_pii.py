import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@", ".", "..", "1", "25", "255", "256", "0", " ", "-", "+", "(", ")", "4111111111111111", "10.0.0.1", "+1 (555) 010-9999", "é", "%", "x@y.z", "1.2.3.4.5.6.7.8", "\n", "_"]), max_size=14))
def test_plain_as_the_patterns_say(parts):
    assert P.plain("".join(parts)) == slow("".join(parts))


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write john (at) example.com now", "email", "john (at) example.com"),
        ("mail jane at example dot org today", "email", "jane at example dot org"),
        ("mail jane dot doe at mail dot example dot org", "email", "jane dot doe at mail dot example dot org"),
        ("mail jane dot a dot b dot c dot d dot e at mail dot example dot org today", "email", "jane dot a dot b dot c dot d dot e at mail dot example dot org"),
        ("an hans punkt mayer klammeraffe beispiel punkt de heute", "email", "hans punkt mayer klammeraffe beispiel punkt de"),
        ("écris à jean arobase exemple point fr demain", "email", "jean arobase exemple point fr"),
        ("escribe a juan [arroba] ejemplo [punto] es ya", "email", "juan [arroba] ejemplo [punto] es"),
        ("call plus one 555 zero one zero 99 nine nine, ok", "phone", "plus one 555 zero one zero 99 nine nine"),
        ("llama más tres cuatro nueve uno dos tres cuatro cinco seis siete hoy", "phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete"),
        ("Karte vier eins 11 1111 eins eins 11 1111 bitte", "card", "vier eins 11 1111 eins eins 11 1111"),
        ("host ten is 10 dot zero dot 0 dot one now", "ip", "10 dot zero dot 0 dot one"),
        ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("mail jo​hn@example.com", "email", "jo​hn@example.com"),
        ("call ＋１ ５５５ ０１０ ９９９９ é", "phone", "＋１ ５５５ ０１０ ９９９９"),
        ("call plus one five five five zero one zero nine nine nine nine, ok", "phone", "plus one five five five zero one zero nine nine nine nine"),
        ("host 10[.]0[.]0[.]1 down", "ip", "10[.]0[.]0[.]1"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises_map_back(text, kind, value):
    base, every = P.identifiers(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base and k == kind] == [(kind, value)]


@pytest.mark.parametrize("text", ["look at example.com", "at one dot two", "we met at noon. dot com at work", "one two", "(at) [dot]", "être à l'école", "meet me at home dot", "", "no one two seven eight nine here", "un point de vue", "der punkt ist null", "in 1999 one of five at work point out", "one 5 a 7 b 2024", "see you at noon punto final", "elle est at home point final"])
def test_clean_texts_stay_clean(text):
    assert P.identifiers(text) == ([], [])


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1 " * 100_000, "one " * 50_000, "a(at)" * 50_000, "x dot " * 50_000, "x dot " * 50_000 + "at y dot z", "a at b dot " * 30_000, "one 5 " * 50_000, "plus " * 50_000):
        P.identifiers(text)


def test_query(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (2, "é 10.0.0.1, +1 (555) 010-9999 a (at) b.cc"), (4, "x" * 1000)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kind string, start int")
    got = sorted(map(tuple, P.digest(P.find_identifiers(docs)).collect()), key=str)
    want = []
    for d, t in rows:
        base, every = slow(t or ""), P.identifiers(t)[1]
        want.append((d, *(sum(k == x for k, *_ in every) for x in P.KINDS), hashlib.sha256(P.listed(base).encode()).hexdigest(), P.listed(every)))
    assert got == sorted(want, key=str)
    assert P.digest(P.find_identifiers(docs.limit(0))).count() == 0
