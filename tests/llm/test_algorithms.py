import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import boost, common, p1_address, p2_permanent, p3_names, p5_blocks, p6_lookalike, p8_mixing


def _pairs(df):
    return {(r.id_a, r.id_b) for r in df.collect()}


def test_pairs_in_classes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcc"), rng.randrange(3)) for i in range(300)] + [(1000, None, 0)]
    df = spark.createDataFrame(rows, "k long, cls string, tag int")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] and a[1] == b[1]}
    assert _pairs(common.pairs_in_classes(df, "cls", "k", block=20)) == want
    differ = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] and a[1] == b[1] and a[2] != b[2]}
    got = common.pairs_in_classes(df, "cls", "k", "tag", block=20).collect()
    assert {(r.id_a, r.id_b) for r in got} == differ and len(got) == len(differ)


def test_plain_equals_python(spark):
    texts = ["Ｆｕｌｌ Ｗｉｄｔｈ１２", "Саfe\u0301 \u200bx\u00ady", "ﬁne o\u2007k", "naïve²", "", "日本 ＡＢ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.composed(common.plain(F.col("t"))).alias("p"))
    assert {r.t: r.p for r in df.collect()} == {t: common.plain_py(t) for t in texts}


def test_address_pairs(spark):
    rows = [
        (1, "Flat 24B, 40 Raimrurus Mg., Near Water Tank, Ninavali-618045"), (2, "FLAT NO. 24B, Amber House, No. 40, Raimrurrus Marg, Ninavali, Kesaria, India"), (3, "#24B; 40 Raimrurus Marg; 618 045; Email: a@b.test"),
        (4, "Flat 24C, 40 Raimrurus Marg, Ninavali-618045"), (5, "Flat 24B, 41 Raimrurus Marg, Ninavali-618045"), (6, "Flat 24B, 40 Raimrurus Path, Ninavali-618045"), (7, "Flat 24B, 40 Raimrurus Marg, Teluvari-614045"),
        (8, None), (9, ""), (1, "Flat 24B, 40 Raimrurus Mg., Near Water Tank, Ninavali-618045"), (10, "word " * 20000), (11, "Shop 3, 9 Other Road, Teluvari 614001"), (12, "Shop 4, 9 Other Road, Teluvari 614001"),
    ]
    assert _pairs(p1_address.same_place(spark.createDataFrame(rows, "k long, text string"), "k")) == {(1, 2), (1, 3), (2, 3)}
    assert p1_address.same_place(spark.createDataFrame([], "k long, text string"), "k").count() == 0


def test_address_helpers():
    assert p1_address.distance("abcd", "abdc", 2) == 1 and p1_address.distance("abcd", "xyz", 1) == 2
    words = ["street", "sreet", "stret", "streeet", "stredt"]
    keys = {w: set(p1_address.deletions(w, 1)) for w in words}
    assert all(keys[a] & keys[b] for a in words for b in words if p1_address.distance(a, b, 1) <= 1)
    assert p1_address.assigned(["amber", "house"], ["hosue", "amber", "x"]) > 0.7


def test_names(spark):
    rows = [
        (1, "f", "Alexander Reivtugas"), (2, "f", "Reivtugas, Alexander"), (3, "f", "ALEXANDER REIVTUGAS"), (4, "f", "Alexandr Reivtugas"), (5, "f", "A. Reivtugas"), (6, "f", "Victoria Reivtugas"), (7, "f", "V Reivtugas"), (8, "f", "Vera Reivtugas"), (9, "g", "Alexander Reivtugas"),
        (10, "f", "Kevnebour Textiles & Co."), (11, "f", "The Kevnebour Tex. and Company, +44 20 7946 0131"), (12, "f", "Kevnebour Motors Limited"), (13, "f", "Motors Kevnebour LTD"), (14, None, "Kevnebour Motors Limited"), (15, "f", None), (16, "f", ""), (1, "f", "Alexander Reivtugas"),
    ]
    got = _pairs(p3_names.same_entity(spark.createDataFrame(rows, "k long, f string, text string"), "k", "f"))
    alex = set(itertools.combinations([1, 2, 3, 4, 5], 2))
    assert got == alex | {(10, 11), (12, 13)}
    assert p3_names.same_entity(spark.createDataFrame([], "k long, f string, text string"), "k", "f").count() == 0


def test_permanent_numbers_keep_choice(spark, tmp_path):
    rows = [(i, "A" if i % 3 else " b ", i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, stratum string, batch_no int")
    one = p2_permanent.Register(spark, str(tmp_path / "one"))
    one.insert(df.where("batch_no < 3"), {"b": 0.5}, 0.1)
    first = {r.id for r in one.sample().collect()}
    one.insert(df.repartition(7), {"b": 0.4}, 0.1)  # rows delivered again, a lower rate
    second = {r.id for r in one.sample().collect()}
    one.insert(df.where("id < 5"), {"b": 0.6}, 0.2)
    third = {r.id for r in one.sample().collect()}
    assert first <= second <= third and len(third) > len(second)
    other = p2_permanent.Register(spark, str(tmp_path / "two"))
    other.insert(df, {"b": 0.5}, 0.1)
    assert {r.id for r in other.sample().collect()} == second
    n = {r.stratum: r.n for r in one.numbers().groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 1333, "b": 667} and abs(len(second) - (1333 * 0.1 + 667 * 0.5)) < 60
    null = p2_permanent.Register(spark, str(tmp_path / "three"))
    null.insert(spark.createDataFrame([(None, None), (1, None)], "id long, stratum string"), {}, 1.0)
    assert [(r.id, r.stratum) for r in null.sample().collect()] == [(1, "unknown")]


def test_register_opened_again(spark, tmp_path):
    df = spark.range(1000).select("id", F.lit("a").alias("stratum"))
    path = str(tmp_path / "r")
    p2_permanent.Register(spark, path).insert(df, {}, 0.5)
    before = {r.id for r in p2_permanent.Register(spark, path).sample().collect()}
    again = p2_permanent.Register(spark, path, seed="another seed is not taken")
    again.insert(df.where("id < 10").union(spark.createDataFrame([(5000, "a"), (5001, "b")], "id long, stratum string")), {}, 0.2)
    after = {r.id for r in p2_permanent.Register(spark, path).sample().collect()}
    assert before <= after <= before | {5000, 5001} and p2_permanent.Register(spark, path).numbers().count() == 1002
    # a log entry that was not written to its end, and an insert that was broken off before it, change nothing
    (tmp_path / "r" / "log" / "000000002.json").write_text('{"numbers": [')
    (tmp_path / "r" / "numbers" / "000000002-x").mkdir()
    assert {r.id for r in p2_permanent.Register(spark, path).sample().collect()} == after
    last = p2_permanent.Register(spark, path)
    last.insert(df, {}, 0.5)
    last.compact()
    assert {r.id for r in p2_permanent.Register(spark, path).sample().collect()} == after
    # two writers at a time: the second gets an error
    one = p2_permanent.Register(spark, path)
    version = one.generation
    one._commit([], [], version)
    with pytest.raises(Exception, match="exist"):
        one._commit([], [], version)


def test_blocks(spark):
    a = "Website: www.x.example | Tel: +91 12345 67890 | Contact Person: Asha Rao"
    rows = [
        (1, a), (2, "CONTACT PERSON - Asha Rao; Website - www.x.example; Tel - +91 12345 67890"), (3, "Tel +91 12345 67890\nContact Person Asha\u200b Rao\nWebsite www.x.example"), (4, a.replace("67890", "67891")), (5, "The café is open."), (6, "THE  CAFÉ is open"), (7, "The cafe is open."),
        (8, "is The café open"), (9, None), (10, ""), (11, "..."), (12, "the cafe\u0301 is open!"), (1, a),
    ]
    got = {r.id: (r.first, r.copies) for r in p5_blocks.block_groups(spark.createDataFrame(rows, "id long, text string"), "id", hot=2).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 10: 10, 11: 10, 12: 5}
    assert got[3][1] == 3 and got[4][1] == 1
    one = p5_blocks.deduplicated(spark.createDataFrame(rows, "id long, text string"), "id")
    assert sorted((r.id, r.n_copies) for r in one.collect()) == [(1, 3), (4, 1), (5, 3), (7, 1), (8, 1), (10, 2)]


def test_merkle_of_nested_columns(spark):
    df = spark.sql("select named_struct('a', 'X y', 'b', array('1', '2')) s, named_struct('b', array('1', '2'), 'a', 'x-Y') t, map('k', 1, 'l', 2) m, map('l', 2, 'k', 1) n, cast(null as string) z, '' e")
    kind = lambda c: df.schema[c].dataType
    r = df.select(*[p5_blocks.merkle(F.col(c), kind(c)).alias(c) for c in df.columns]).first()
    assert r.s == r.t and r.m == r.n and r.z != r.e
    arr = spark.sql("select array('1', '2') a, array('2', '1') b")
    o = arr.select(p5_blocks.merkle(F.col("a"), arr.schema["a"].dataType).alias("a"), p5_blocks.merkle(F.col("b"), arr.schema["b"].dataType).alias("b"), p5_blocks.merkle(F.col("b"), arr.schema["b"].dataType, False).alias("u"), p5_blocks.merkle(F.col("a"), arr.schema["a"].dataType, False).alias("v")).first()
    assert o.a != o.b and o.u == o.v


def test_looks(spark):
    rows = [(1, "f", "Café 12"), (2, "f", "Cafe\u0301 12"), (3, "f", "Саfé\u200b 1２"), (4, "f", "Cafe 12"), (5, "f", "café 12"), (6, "f", "Café  12"), (7, "f", "Café 1²"), (8, "g", "Café\u00a012"), (9, None, "Café 12"), (10, "f", None), (11, "f", "Café 12"), (12, "f", "Café\t12")]
    df = spark.createDataFrame(rows, "k long, f string, text string")
    same = {1, 2, 3, 11}
    assert _pairs(p6_lookalike.look_pairs(df, "k", within="f")) == {(a, b) for a, b in itertools.combinations(sorted(same), 2) if (a, b) != (1, 11)}
    c = {r.k: r.canonical for r in p6_lookalike.canonicalise(df).collect()}
    assert len(c) == len(rows) and {c[k] for k in (1, 2, 3, 8, 9, 11)} == {"Café 12"} and c[10] is None and c[5] == "café 12"


def test_boost_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(np.float32)
    m = boost.Boosted(rounds=30).fit(x[:3000], y[:3000]).calibrate(x[3000:3500], y[3000:3500])
    p = m.score(x[3500:])
    assert ((p > 0.5) == (y[3500:] > 0)).mean() > 0.95 and abs(p.mean() - y[3500:].mean()) < 0.05
    assert (boost.Boosted().fit(x[:5], np.ones(5)).score(x[:3]) > 0.5).all() and boost.Boosted().fit(x[:0], y[:0]).score(x[:2]).shape == (2,)


def test_cube_flight():
    rng = np.random.default_rng(1)
    x, p = rng.integers(100, 5000, 3000).astype(float), np.full(3000, 0.3)
    q = p8_mixing.flight(np.arange(3000), p, x, "s")
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-3
    z = p8_mixing.landing(np.arange(3000), q, "s")
    assert set(np.unique(z)) <= {0.0, 1.0} and abs(z.sum() - p.sum()) <= 1
    means = np.mean([p8_mixing.landing(np.arange(9), p8_mixing.flight(np.arange(9), np.full(9, 0.4), np.arange(1.0, 10.0), str(s)), str(s)) for s in range(1500)], axis=0)
    assert np.abs(means - 0.4).max() < 0.06  # inclusion probabilities are kept
    assert len(p8_mixing.flight(np.arange(4), np.full(4, 0.5), np.full(4, 7.0), "s")) == 4


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big", "big", "BIG ", "small"]), "word " * rng.randrange(1, 60)) for i in range(800)] + [(9000, "tiny", "one two three"), (9001, None, "x"), (9002, "big", None), (9003, "none", "x y"), (None, "big", "x")]
    df = spark.createDataFrame(docs, "id long, source string, text string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("gone", 0.2, 3)], "source string, target_share double, max_repeats int")
    out, report = p8_mixing.mixed(df, "id", goal, bucket=50)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 0.5) < 0.01 and abs(r["small"].actual_share - 0.5) < 0.01 and r["gone"].mixed_tokens == 0
    rows = out.collect()
    assert len({x.id for x in rows}) == len(rows) and all(1 <= x.copies <= (1 if x.source == "big" else 2) for x in rows)
    again = {(x.id, x.copies) for x in p8_mixing.mixed(df.repartition(5), "id", goal, bucket=50)[0].collect()}
    assert again == {(x.id, x.copies) for x in rows}
    empty = p8_mixing.mixed(df.limit(0), "id", goal)
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_roots_of_long_chains_and_cycles(spark):
    links = [(n, n + 1) for n in range(1, 40)] + [(51, 52), (52, 53), (53, 51)] + [(n, n + 1) for n in range(60, 70)] + [(70, 52), (80, 1), (90, 91)]
    nodes = spark.createDataFrame([(n,) for n in {x for e in links for x in e} | {99}], "node long")
    got = {r.node: r.root for r in common.rooted(nodes, spark.createDataFrame(links, "node long, up long")).collect()}
    assert got == {**dict.fromkeys([*range(1, 41), 80], 40), **dict.fromkeys([51, 52, 53, *range(60, 71)], 51), 90: 91, 91: 91, 99: 99}
    none = common.rooted(nodes, spark.createDataFrame([], "node long, up long"))
    assert all(r.node == r.root for r in none.collect()) and none.count() == nodes.count()


def test_address_chain(spark):
    street = "abcdefghijklmnop"
    names = [street]
    for n in range(7):  # each two letters from the last
        names.append(names[-1][: 2 * n] + "zz" + names[-1][2 * n + 2 :])
    rows = [(k, f"Flat 2B, 40 {s} Road, Ninavali-618045") for k, s in enumerate(names)]
    rows += [(100 * n + k, rows[n][1]) for n in range(8) for k in range(10, 18 - n)]  # the first is the most frequent, and so on
    got = {r.place for r in p1_address.places(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert len(got) == 1


def test_names_of_common_tokens(spark):
    rows = [(1, "f0", "R. Kumar"), (2, "f0", "Ramesh Kumar"), (3, "f1", "Ottilie B."), (4, "f1", "Ottilie Brown"), (5, "f2", "Bob Kumar"), (6, "f2", "Robert Kumar"), (7, "f3", "Kumar"), (8, "f3", "Xavier Kumar")]
    rows += [(100 + n, f"f{n}", f"{a} Kumar") for n, a in enumerate(["Ottoman", "Vanessa"] * 30) if n > 3]
    rows += [(200 + n, f"f{n}", "Ottilie Fernsby") for n in range(60) if n > 3]
    got = _pairs(p3_names.same_entity(spark.createDataFrame(rows, "k long, f string, text string"), "k", "f"))
    assert got == {(1, 2), (3, 4), (5, 6), (7, 8)}


def test_addresses_without_street(spark):
    rows = [(1, "Plot 12, Sector 5, Ninavali 618045"), (2, "PLOT 12; Sector 5 - Ninavali-618045, Tel: +91 98765 43210"), (3, "Plot 12, Sector 6, Ninavali 618045"), (4, "Amber House, Kesaria"), (5, "Amber House, Kesaria"), (6, "Pearl House, Kesaria"), (7, " ,; "), (8, "Plot 12, Goxjedruv Road, Ninavali 618045"), (9, None)]
    df = spark.createDataFrame(rows, "k long, text string")
    assert _pairs(p1_address.same_place(df, "k")) == {(1, 2), (4, 5)}
    assert {r.k for r in p1_address.places(df, "k").collect()} == {1, 2, 3, 4, 5, 6, 8}


def test_parts_left_out(spark):
    rows = [
        (1, "Flat No. 12, 45 Rajaji Road, Chennai 600001"), (2, "45 Rajaji Road, Chennai 600001"), (3, "Rajaji Road, Chennai 600001"), (4, "Flat No. 12, 45 Rajajj Rd"),
        (11, "Flat 1, 7 Temple Road, Chennai 600001"), (12, "Flat 2, 7 Temple Road, Chennai 600001"), (13, "7 Temple Road, Chennai 600001"),  # two flats fit: a place of its own
        (21, "Flat 1, 7 Temple Street, Chennai 600001"), (22, "9 Rajaji Lane, Chennai 600001"),
    ]
    got = {}
    for r in p1_address.places(spark.createDataFrame(rows, "k long, text string"), "k").collect():
        got.setdefault(r.place, set()).add(r.k)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4], [11], [12], [13], [21], [22]]


def test_assignment_is_the_best():
    rng = random.Random(7)
    near = p1_address._near
    vocabulary = ["amber", "ambre", "house", "hosue", "park", "lake", "a", "b", "fort", "forts", "mill"]
    for _ in range(200):
        a, b = ([rng.choice(vocabulary) for _ in range(rng.randrange(1, 7))] for _ in range(2))
        s, w = (a, b) if len(a) <= len(b) else (b, a)
        best = max(sum(near(x, y) for x, y in zip(s, q)) for q in itertools.permutations(w, len(s))) / len(s)
        assert abs(p1_address.assigned(a, b) - best) < 1e-9
    assert p1_address.assigned(["a", "a"], ["a", "b", "c", "d", "e", "f"]) == p1_address.assigned(["a", "a"], ["a", "b", "c", "d", "e"])


def test_localities_tell_the_area(spark):
    rows = [(k, f"Flat {k}, {k} Goxjedruv Road, Pallipet, Teluvari 614{k:03d}") for k in range(1, 9)] + [(20, "Flat 3, 3 Goxjedruv Road, Pallipet")]
    rows += [(30 + k, f"Flat {k}, {k} Goxjedruv Road, Nungapet, Ninavali 618{k:03d}") for k in range(1, 9)]
    got = {r.k: r.place for r in p1_address.places(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert got[20] == got[3] != got[33] and len(set(got.values())) == 16


def test_names_broadcast_no_expanded_keys(spark, monkeypatch):
    """Hashes made in Python are far more bytes than Spark reckons: the driver must not collect them for a broadcast."""
    plans = []

    def noted(df, name="stage"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return common.stored(df, name)

    monkeypatch.setattr(p3_names, "stored", noted)
    rows = [(i, f"f{i % 3}", t) for i, t in enumerate(["Ashavari Raomekar", "Ashavari Raomekkar", "AshavariRaomekar", "A. Raomekar", "Tilo Brandmann"] * 3)]
    out = p3_names.entities(spark.createDataFrame(rows, "k long, f string, text string"), "k", "f")
    assert out.count() == len(rows)
    joins = [line for p in plans for line in p.splitlines() if "Join [h#" in line]
    assert len(joins) >= 4 and not [x for x in joins if "Broadcast" in x], joins
