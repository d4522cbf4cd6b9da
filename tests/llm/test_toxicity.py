import random
import zlib

from vertexloom.llm import toxicity as T


def test_labels_of_matches():
    g = T.Grammar()
    at = lambda text: [(e, T.LABELS[k]) for e, k in g.matches(text)]
    assert at("What an idiot.") == [("idiot", "plain")]
    assert at("You are an idiot, friend") == [("idiot", "aimed")]
    assert at("They are not stupid at all") == [("stupid", "negated")]
    assert at('He said: "you moron"') == [("moron", "reported")]
    assert at("She said so. You moron") == [("moron", "aimed")]
    assert at("I will find you") == [("find you", "threat")]
    assert at("never will we hurt you") == [("hurt you", "threat")] or at("never hurt you") == [("hurt you", "negated")]
    assert at("the trashed clowns") == []


def test_context_orders_scores():
    g = T.Grammar()
    plain, aimed, negated, reported, clean = (g.score(t) for t in ("what an idiot", "you idiot", "he is not an idiot", "they wrote idiot", "what a day"))
    assert aimed > plain > negated > clean and plain > reported > clean
    assert g.score(None) == g.score("") == g.score(" \n") == clean


def data(n=1500):
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lo", "mi", "tan", "res", "nu")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 150))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "zlotar", "zlotarei", "zlotarsk", "idiot"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 0, int(toxic)))
    return rows + [(None, None), (n, ""), (n, "")], labels + [(None, 0, 1), (n, None, None)]


def frames(spark, rows, labels):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = data()
    docs, marks = frames(spark, rows, labels)
    g = T.fit(docs, marks)
    assert g == T.fit(docs, marks) and len(g.terms) < 60
    got = T.scores(docs, g).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None and r.doc_id is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = T.drop_toxic(docs, g)
    assert out.columns == docs.columns and out.count() == sum(r.predicted == 0 for r in got)


def test_without_labels(spark):
    docs, marks = frames(spark, [(1, "you idiot"), (2, "fine")], [])
    assert T.fit(docs, marks) == T.Grammar()
    assert [r.predicted for r in T.scores(docs, T.Grammar()).orderBy("doc_id").collect()] == [1, 0]
    assert T.scores(docs.limit(0), T.Grammar()).count() == 0 and T.drop_toxic(docs.limit(0), T.Grammar()).count() == 0


def slow_matches(g, text):
    """The transducers one by one, without composition: labels straight from the rules."""
    read = T.tokens(text)
    ends = lambda t: t in T.MARKS
    found, report, quoted = [], False, False
    for i, t in enumerate(read):
        if ends(t):
            if T.MARKS[t] == T.QUOTE:
                quoted = not quoted
            elif T.MARKS[t] == T.STOP:
                report = False
            elif T.MARKS[t] == T.LINE:
                report = quoted = False
            continue
        if t in T.REPORTS:
            report = True
        clause = []  # words of the clause up to this one, last first
        for x in reversed(read[: i + 1]):
            if ends(x):
                break
            clause.append(x)
        # a negation holds for NEGATION_SPAN words with itself as the last but one to count
        negated = any(x in T.NEGATIONS for x in clause[: T.NEGATION_SPAN])
        ahead = next((n for n, x in enumerate(read[i + 1 : i + 1 + T.TARGET_SPAN]) if ends(x)), T.TARGET_SPAN)
        aimed = any(x in g.targets for x in clause[: T.TARGET_SPAN]) or any(x in g.targets for x in read[i + 1 : i + 1 + ahead])
        if t not in T.REPORTS and t not in T.NEGATIONS and g.entry(t) is not None:
            found.append((g.entry(t), T.NEGATED if negated else T.REPORTED if report or quoted else T.AIMED if aimed else T.PLAIN))
        for phrase in sorted(g.phrases):
            n = len(phrase.split())
            if clause[:n][::-1] == phrase.split():
                found.append((phrase, T.NEGATED if negated else T.REPORTED if report or quoted else T.THREAT))
    return found


def test_composition_equals_the_rules():
    rng = random.Random(3)
    g = T.Grammar(T.Grammar().terms | {"lowei*": 2.0, "lowe*": 1.0, "you": 0.5}, T.Grammar().phrases | {"die you": 1.0, "you will": 2.0}, T.TARGETS | {"folk"})
    pool = [*T.SEED_INSULTS[:4], "loweigh", "lowers", "folk", *sorted(T.NEGATIONS)[:3], *sorted(T.REPORTS)[:3], *"you they kill hurt will die find u deserve to a b c d".split(), *T.MARKS]
    for _ in range(1500):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(25)))
        assert sorted(g.matches(text)) == sorted(slow_matches(g, text)), text


def test_words_are_cut_in_one_way():
    g = T.Grammar(T.Grammar().terms | {"écrasé": 3.0})
    plain, reported = g.score("that idiot"), g.score('that "idiot" again')
    assert g.score("that—idiot") == g.score("that idiot…") == g.score("THAT IDIOT") == plain and g.score("that “idiot” again") == reported < plain
    assert g.matches("Écrasé") == [("écrasé", T.PLAIN)] and T.words_of("Don’t isn't l’eau") == ["don't", "isn't", "l'eau"]


def test_pairs_become_threats_and_very_long_texts(spark):
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lo", "mi", "tan", "res", "nu")]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(60)] + ["balo", "x", "dami"]
        if i % 5 == 0:  # both words are common, the pair isn't
            at = rng.randrange(50)
            w[at : at + 2] = ["balo", "dami"]
        else:
            w = [x for n, x in enumerate(w) if not (x == "dami" and n and w[n - 1] == "balo")]
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(i % 5 == 0)))
    rows.append((5000, "word " * 300_000 + "balo dami"))
    docs, marks = frames(spark, rows, labels)
    g = T.fit(docs, marks)
    assert "balo dami" in g.phrases and "balo dami" in {e for e, _ in g.matches("so balo dami here")}
    got = {r.doc_id: r.predicted for r in T.scores(docs, g).collect()}
    assert sum(got[i] == t for i, _, t in labels) > 0.97 * len(labels) and got[5000] == 1
