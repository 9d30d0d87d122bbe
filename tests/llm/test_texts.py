import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import p4_personal, p7_leak, p9_language

NAMES = ["Asha", "Rohan", "Meera", "Vikram", "Nandini", "Farah"]
LAST = ["Tendrubov", "Reivtugas", "Bannuvos", "Krerpomez", "Seigdruzir", "Zudfubour"]


def _world(spark):
    import random

    rng = random.Random(5)
    spans, blocks = [], []
    for i in range(240):
        n = f"{rng.choice(NAMES)} {rng.choice(LAST)}"
        a = f"Flat {i % 40}B, {i + 3} {rng.choice(['Raimrurus', 'Pouzbobrup', 'Goxjedruv'])} Road, Saffron Park, Ninavali - 618{i % 1000:03d}"
        spans += [("PERSON", n), ("ADDRESS", a), ("ORG", f"{rng.choice(LAST)} Steel Limited")]
        phone, mail = f"+91 9{i:04d}55{i % 1000:03d}", f"{n.split()[0].lower()}{i}@mail.example"
        blocks.append(f"Contact Person: {n}\nPhone: {phone}\nE-mail: {mail}\nRegistered Office: {a}\nOur Ref: Invoice No. KD-{i:04d}-77{i:03d}\nSEBI Registration No: INM000{i:06d}\nVoter ID: ABC{i:07d}")
        blocks.append(f"The board approved the issue of {i}000 shares at its meeting. Ref. No. 8{i:08d}")
    return spark.createDataFrame([(b,) for b in blocks], "text string"), spark.createDataFrame(spans, "entity_type string, text string")


def test_personal_items(spark):
    blocks, spans = _world(spark)
    model = p4_personal.fit(blocks, spans)
    t = "Our Promoter Meera Krerpomez (mobile +91 98765 43210) resides at Flat 9B, 77 Goxjedruv Road, Saffron Park, Ninavali - 618001 and wrote to m\u200beera at mail dot example. Ref. No. 812345678"
    rows = [(1, t), (2, None), (3, ""), (4, "nothing"), (5, "Contact Person: Asha Reivtugas\nPhone: +91 90000 55111")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.entity_type, dict(rows)[r.id][r.start_pos : r.end_pos]) for r in p4_personal.items(df, "id", "text", model).collect()}
    assert (1, "PERSON", "Meera Krerpomez") in got and (1, "PHONE", "+91 98765 43210") in got and (1, "EMAIL", "m\u200beera at mail dot example") in got
    assert (1, "ADDRESS", "Flat 9B, 77 Goxjedruv Road, Saffron Park, Ninavali - 618001") in got and (5, "PERSON", "Asha Reivtugas") in got
    assert not [g for g in got if "812345678" in g[2]] and not [g for g in got if g[0] in (2, 3, 4)]
    red = {r.id: r.redacted for r in p4_personal.redacted(df, "id", "text", model).collect()}
    assert red[2] is None and red[3] == "" and red[4] == "nothing" and red[5] == "Contact Person: [PERSON]\nPhone: [PHONE]"
    only = p4_personal.items(df, "id", "text", model, ("PHONE",)).collect()
    assert {r.entity_type for r in only} == {"PHONE"} and len(only) == 2


def test_guard_is_implied(spark):
    texts = ["+91 98765 43210", "(214) 555-0169", "a.b@c.org", "x dot y at z dot com", "ABCDE1234F", "A1234567", "ABC1234567", "1234 5678 9012", "219-09-9999", "no data 12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(p4_personal.GUARD).alias("g"))
    words = p4_personal.Words({}, {}, set())
    for r in df.collect():
        assert r.g or not p4_personal.propose(r.t, words, frozenset(p4_personal.TYPES))


ITEM = "The keeper of the Brournvetol archive controls the seven sealed jars of Tablaibreish while the Hobmeiloup lattice of order 512 preserves the border between Zotnolond and Feinroudraix under mild conditions, as every volunteer noticed."


def test_leaks(spark):
    w = ITEM.split()
    marked = " ".join(f"\\emph{{{x}}}" if i % 4 == 0 else x for i, x in enumerate(w)).replace("Zotnolond", "Zot-\nnolond")
    filler = "Section 4 returns to the energy of the system and to the role of the smaller detector. " * 6
    docs = [
        (1, filler + ITEM + filler), (2, filler + marked.upper()), (3, filler + " ".join(w[: len(w) // 2 + 3]) + "\n\n" + filler), (4, " ".join(w[:9]) + " " + filler), (5, filler), (6, None), (7, ""),
        (8, " ".join(w[:12]) + " " + filler + " " + " ".join(w[12:26])), (9, "Brournvetol Tablaibreish Hobmeiloup Zotnolond Feinroudraix " + filler), (10, filler * 400 + ITEM), (1, filler + ITEM + filler),
    ]
    docs += [(100 + n, filler + f"Another sentence about case {n}: as every volunteer noticed, the seven sealed jars of order 512 preserve conditions; the lattice preserves the border while the keeper controls the archive under mild conditions.") for n in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(70, ITEM), (71, "short"), (72, None), (70, ITEM)], "item_id long, text string")
    got = p7_leak.leaks(d, "doc_id", i, "item_id").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 70), (2, 70), (3, 70), (8, 70), (10, 70)]
    assert p7_leak.leaks(d, "doc_id", i.limit(0), "item_id").count() == 0


def test_wand_equals_exhaustive():
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(80)]
    ix = p7_leak.Index(items, {w: rng.randrange(1, 15) for w in words}, 1000, 0.3, block=4)
    for _ in range(60):
        q = {rng.choice(words) for _ in range(rng.randrange(1, 25))}
        score = {}
        for w in q:
            for i, x in ix.post.get(w, ()):
                score[i] = score.get(i, 0) + x
        assert sorted(ix.search(q)) == sorted(i for i, s in score.items() if s >= 1 - 1e-9)


SAMPLES = {
    "en": ["The inner loop controls the signal in the far field.", "We show that this relaxation reduces the memory of the system.", "None of the volunteers noticed that the model hides the drift."],
    "de": ["Wir zeigen, dass der zweite Versuch die Steigung der Kurve verringert.", "Daraus folgt, dass unser Modell den Fehler nicht verändern kann.", "Die Messung wurde wiederholt und die Vorstudie erhält die Breite der Lücke."],
    "fr": ["Nous montrons que le solveur réduit la pente de la courbe.", "Il en résulte que le second essai ne peut modifier l'énergie du système.", "La figure suggère que la campagne pilote suit le nombre de passages."],
}


def test_languages(spark):
    s = spark.createDataFrame([(k, t) for k, v in SAMPLES.items() for t in v], "lang string, text string")
    en, de, fr = ("\n".join(v) for v in SAMPLES.values())
    pre = "\\documentclass{article}\n\\title{Wir zeigen, dass die Kurve}\n\\begin{document}\n"
    docs = [
        (1, pre + en + "\n\n% " + de.replace("\n", "\n% ") + "\n\\section{Verwandte Arbeiten der Gruppe}\n" + en, "German"), (2, en + "\n\n" + de, "en-US"), (3, fr.replace("é", "\\'e"), None), (4, None, "en"), (5, "", ""), (6, "$x=1$ 42", "xx"), (7, (en + "\n") * 300, "und"),
    ]
    got = {r.doc_id: r for r in p9_language.languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", s, keep=["lang"]).collect()}
    assert got[1].lang == "en" and len(got[1].shares) == 1 and got[3].lang == "fr" and got[7].lang == "en"
    assert {x.lang for x in got[2].shares} == {"en", "de"} and [p.lang for p in got[2].passages] == ["de" if got[2].lang == "en" else "en"]
    p = got[2].passages[0]
    assert docs[1][1][p.start_pos : p.end_pos].startswith("Wir" if p.lang == "de" else "The")
    assert got[4].lang is None and got[5].lang is None and got[6].lang is None and got[6].shares == []
    labels = spark.createDataFrame([(x,) for x in ("EN", "en_GB", "Deutsch", "fre", "pt-BR", "Hindi", "und", "", None, "xx")], "l string")
    assert [r[0] for r in labels.select(p9_language.label_language(F.col("l"))).collect()] == ["en", "en", "de", "fr", "pt", "hi", None, None, None, None]


def test_half_an_item_that_many_documents_quote(spark):
    w = ITEM.split()
    half = len(w) // 2 + 1
    docs = [(n, f"Case {n} of the file. " + " ".join(w[:half]) + f" End of case {n}.") for n in range(400)] + [(500, "Before. " + ITEM)]
    docs += [(600 + n, " ".join(w[4:13]) + f" is what case {n} says and then goes on with other things; " + " ".join(w[20:29])) for n in range(100)]
    docs += [(1000 + n, f"Nothing of the kind is in text {n} of this corpus.") for n in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    got = {r.doc_id for r in p7_leak.leaks(d, "doc_id", i, "item_id").collect()}
    assert got == {*range(400), 500, *range(600, 700)}


def test_many_word_forms():
    rows = [(k, t) for k, v in SAMPLES.items() for t in v]
    texts = ["\n".join(v) + f"\n\nWord{chr(97 + n)}s never seen before. " + SAMPLES["de"][0] for n in range(3) for v in SAMPLES.values()]
    free, few = p9_language.Model(rows), p9_language.Model(rows)
    few.forms = 12
    for t in texts + texts:
        assert p9_language.analyse(t, few, few.langs) == p9_language.analyse(t, free, free.langs)
    old = p9_language.Model(rows)
    old.rows = [np.zeros(len(old.langs))] * 400_000  # as after many documents
    old.known = {f"{n}": n for n in range(400_000)}
    assert p9_language.analyse(texts[0], old, old.langs) == p9_language.analyse(texts[0], free, free.langs)


def test_mixture_is_the_maximum_of_its_objective():
    rng = np.random.default_rng(4)
    n, k = 60, 3
    true = rng.choice(2, n, p=[0.7, 0.3])
    ll = rng.normal(0, 1, (n, k)) - 3.0
    ll[np.arange(n), true] += 2.5  # uncertain sentences: proportions are no counts of best languages
    size = rng.integers(3, 40, n).astype(float)
    p, post = p9_language.mixture(ll, size)
    value = lambda q: float((size / size.mean() * np.log(np.maximum((np.exp(ll) * q).sum(1), 1e-300))).sum())
    use = np.flatnonzero(p > 0)
    assert abs(p.sum() - 1) < 1e-6 and np.allclose(post.sum(1), 1)
    for i in use:
        for j in set(use.tolist()) - {int(i)}:
            q = p.copy()
            step = min(0.02, q[i])
            q[i], q[j] = q[i] - step, q[j] + step
            assert value(q) <= value(p) + 0.02


def test_language_beyond_the_eight(spark):
    sv = ["Vi visar att den andra slingan styr signalen i fältet.", "Mätningen upprepades och felet blev mindre än väntat."]
    s = spark.createDataFrame([(k, t) for k, v in {**SAMPLES, "sv": sv}.items() for t in v], "lang string, text string")
    got = p9_language.languages(spark.createDataFrame([(1, "\n".join(sv))], "doc_id long, text string"), "doc_id", s).first()
    assert got.lang == "sv"
    labels = spark.createDataFrame([("sv-SE",), ("sv",), ("de",)], "l string")
    assert [r[0] for r in labels.select(p9_language.label_language(F.col("l"), ("sv",))).collect()] == ["sv", "sv", "de"]


def test_leak_recall_against_all_pairs():
    """Every tenth document (by id) against every item, without index: the search finds at least nine tenths (all, at this writing)."""
    import os
    from collections import Counter

    import pyarrow.parquet as pq
    import pytest

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    if not os.path.exists(f"{path}/documents.parquet"):
        pytest.skip("no test tables")
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["text"]]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{path}/eval_item.parquet").to_pylist() if r["text"]]
    vocabulary = {w for _, t in items for w in p7_leak.words(t)}
    df = Counter()
    for _, t in docs:
        df.update(vocabulary.intersection(p7_leak._quick(t)))
    ix = p7_leak.Index(items, df, len(docs), 0.12)
    want, got = set(), set()
    for k, t in docs:
        if k % 10 == 0:
            doc = p7_leak.words(t)
            want |= {(k, ix.ids[i]) for i in range(len(items)) if p7_leak.overlap(ix.tokens[i], ix.weight[i], doc)[0] >= 0.5}
            got |= {(k, x[0]) for x in p7_leak.held(t, ix, 0.5, 160)}
    assert got <= want and len(want) > 20 and len(got) >= 0.9 * len(want), (len(got), len(want))
    print("leaks:", len(got), "of", len(want))


def test_question_and_answer_are_told_apart(spark):
    item = "Which of the seven sealed jars of Tablaibreish does the keeper of the Brournvetol archive open first, before the border between Zotnolond and Feinroudraix is closed? Answer: the jar of the Hobmeiloup lattice of order 512, which every volunteer of Zudfubour had noticed under mild conditions on the second day of calibration."
    question, answer = item.split("? Answer: ")
    filler = "Section 4 returns to the energy of the system and to the role of the smaller detector. " * 4
    docs = [(1, filler + item), (2, filler + question + ". " + filler), (3, filler + answer + filler), (4, filler), (5, "It says: Zotnolond is closed. " + filler)]
    got = {(r.doc_id, r.item_id): r for r in p7_leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame([(7, item), (8, "Zotnolond is closed."), (9, "never there")], "item_id long, text string"), "item_id", least=0.4).collect()}
    assert {k: r.part for k, r in got.items()} == {(1, 7): "both", (2, 7): "question", (3, 7): "answer", (5, 8): "answer"}
    # a few common words of the filler may carry a piece on beyond the cut
    assert got[2, 7].answer_held < 0.4 and got[3, 7].question_held < 0.4 and got[1, 7].question_held == 1
    assert p7_leak.answer_at("One sentence here. The last one.") == 3 and p7_leak.answer_at("none") == 0


def test_personal_items_on_unseen_sentences(spark):
    """Recall and precision on sentences that the training has not seen, with names that are on the lists and names that are on none."""
    import random

    blocks, spans = _world(spark)
    prose = [f"Our director {n} {x} chairs the committee and has been with the group since {y}." for y, (n, x) in enumerate([(a, b) for a in NAMES for b in LAST], 1980)]
    prose += [f"A letter to {n} {x} came back unopened in {y}." for y, (n, x) in enumerate([(a, b) for b in LAST for a in NAMES], 1980)]
    model = p4_personal.fit(blocks.union(spark.createDataFrame([(p,) for p in prose], "text string")), spans)
    rng = random.Random(9)
    texts, gold = [], set()
    for i in range(120):
        name = f"{rng.choice(NAMES)} {rng.choice(LAST)}" if i % 3 else f"{rng.choice(['Ingrid', 'Pablo', 'Tomasz'])} {rng.choice(['Vuolteen', 'Okonjo', 'Szymborek'])}"
        title = "Dr. " if i % 3 == 0 else ""
        a, b = [("The deed names ", " as the sole heir."), ("Minutes were kept by ", " until spring."), ("It was ", " who found the fault in the ledger."), ("Yesterday, ", " left the bench.")][i % 4]
        t = a + title + name + b
        texts.append((i, t))
        gold.add((i, "PERSON", len(a + title), len(a + title + name)))
    texts += [(1000 + i, t) for i, t in enumerate(["The Board approved Equity Shares and the Draft Red Herring Prospectus.", "Amber Steel Limited and Pearl Foods Private Limited agreed.", "See Chapter Nine."])]
    got = {(r.id, r.entity_type, r.start_pos, r.end_pos) for r in p4_personal.items(spark.createDataFrame(texts, "id long, text string"), "id", "text", model).collect()}
    recall = len(got & gold) / len(gold)
    unlisted = {g for g in gold if g[0] % 3 == 0}
    print("recall", recall, "unlisted", len(got & unlisted) / len(unlisted), "precision", len(got & gold) / len(got))
    assert recall > 0.8 and len(got & unlisted) > 0.5 * len(unlisted) and len(got & gold) > 0.8 * len(got)


def test_the_list_of_names_is_not_walked_for_each_text():
    """The list grows with the data; a text looks up its own words only."""
    walked = []

    class Listed(dict):
        def __iter__(self):
            walked.append(1)
            return super().__iter__()

    words = p4_personal.Words(Listed({x.lower(): 3.0 for x in NAMES + LAST}), {}, set())
    walked.clear()
    assert ("PERSON", 7, 21) in p4_personal.propose("Signed Asha Tendrubov here.", words) and not p4_personal.propose("the board has met in june", words)
    assert not walked


def test_numbers_and_addresses_are_found_where_their_patterns_find_them():
    """Texts are searched in part, or not at all, where the signs of numbers tell that there is none: the same is found as by every pattern over all of the text."""
    import random

    rng = random.Random(3)
    parts = ["ABCDE1234F", "abcde 1234 f", "xABCDE1234F", "ABC1234567", "J7603526", "123-45-6789", "1234 5678 9012", "1234-5678\t9012", "1234\x1c5678    9012", "12345678 9012", "+91 (22) 2345 6789", "(022) 23456789"]
    parts += ["98765 43210", "tel 2345 67890", "a.b+c@d-e.co.in", ".x@y.com-z@w.org", "q@r.net\n", "INM000012345", "É", "٣", "²", "mm/", "_", "@", "(", ")", "+", "-", ".", "/", " ", "  ", "\n", "7", "x"]
    kinds = {"EMAIL", "PHONE", *p4_personal._IDS.groupindex}
    found = set()
    for _ in range(4000):
        t = rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(1, 9)))
        want = {(m.lastgroup, *m.span()) for m in p4_personal._IDS.finditer(t)} | {("EMAIL", *m.span()) for m in p4_personal._PLAIN_EMAIL.finditer(t)}
        for m in p4_personal._PHONE.finditer(t):
            d = sum(map(str.isdecimal, m[0]))
            if 9 <= d <= 14 and (d > 9 or m[0][0] in "+(" or p4_personal._CUES["PHONE"].search(t.lower(), max(0, m.start() - 40), m.start())):
                want.add(("PHONE", *m.span()))
        assert {c for c in p4_personal.propose(t, p4_personal.Words({}, {}, set())) if c[0] in kinds} == want, t
        found |= {c[0] for c in want}
    assert found == kinds
