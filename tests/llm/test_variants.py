"""Links of typed names: words and similarity, the joins against all pairs, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from scoria.functions.geo import haversine_m
from scoria.llm.jvm import register, t
from scoria.llm.linkage import CHUNKS, _pairs, calibrate, chance_of, match_entities
from scoria.llm.variants import LEAST, REACH_M, link_classes, link_variants, name_classes, word_rarity

RECORD = "t int, id string, name string, kind string, lon double, lat double"


@pytest.fixture(scope="module")
def alike(spark):
    """Similarity of two names beside some others, whose words make some common."""
    register(spark)

    def of(a, b, others=(), kinds=("summit", "summit")):
        names = spark.createDataFrame([(n,) for n in [a, b, *others]], "name string")
        rarity = F.lit(word_rarity(names))
        one = spark.createDataFrame([(a, b)], "a string, b string")
        return one.select(t("NameAlike", F.col("a"), F.lit(kinds[0]), F.col("b"), F.lit(kinds[1]), rarity)).first()[0] or 0.0

    return of


def test_words(spark):
    register(spark)
    names = [("Lieweaph, James Peak", ["jams", "liweaf"], 1), ("The MNT. Quea brelwea", ["brelwea", "kea"], 1), ("X C.G.", None, None), ("7 Foo Fls", ["foo", "seven"], 4),
             ("Spring", None, None), ("Foo Peek", ["foo"], 1), ("Two Mountian", ["two"], 1), (None, None, None), ("", None, None), ("(no name)", None, None), ("N/A", None, None), ("Bill Pk", ["william"], 1)]
    got = spark.createDataFrame([(n,) for n, _, _ in names], "n string").select("n", t("NameWords", F.col("n")).alias("w"), t("NameFamily", F.col("n")).alias("f")).collect()
    for (n, words, family), r in zip(names, got):
        assert r["f"] == family, n
        if words:
            assert sorted(r["w"]) == sorted(w.replace("jams", "james") for w in words), n


OTHERS = [f"{w} Place{i}" for i in range(60) for w in ("Silver", "East", "West", "Big", "Cedar", "Robert", "Henry")][:300]


def test_similarity(alike):
    same = [("Silver Peak", "Slvr Pk"), ("Cedar Spring", "Ceder Spg"), ("Green Eagle Peak", "Eagle Green Peak"), ("E. Foolano Peak", "East Foolano Peak"), ("Bob Foolano", "Robert Foolano"),
            ("W. Foolano", "William Foolano"), ("Foolano", "Henry Foolano"), ("Ruba send Falls", "Rubasend Fall"), ("Skaiviltfe Peak", "Skai viltfe Pk."), ("Cedar Rubasend", "Ceder Ruba send")]
    apart = [("East Foolano Peak", "West Foolano Peak"), ("Big Foolano", "Foolano"), ("Robert Foolano", "Henry Foolano"), ("Silver Foolano", "Cedar Foolano"), ("Foolano Peak", "Barbekim Peak"),
             ("E. Foolano", "West Foolano"), ("East Foolano", "Foolano"), ("N Foolano", "S Foolano"), ("Silver Peak", "Cedar Peak"), ("Granite Dome", "Copper Mountain")]
    for a, b in same:
        assert alike(a, b, OTHERS) >= LEAST, (a, b)
        assert alike(a, b, OTHERS) == pytest.approx(alike(b, a, OTHERS))
    for a, b in apart:
        assert alike(a, b, OTHERS) < LEAST, (a, b)
    assert alike("Foolano Spring", "Foolano Cave") == 0 and alike("Foolano", "Foolano", kinds=("summit", "rock")) == 1 and alike("Foolano", "Foolano", kinds=("summit", "cave")) == 0


def test_rarity_decides(alike):
    """A word that only one name has tells places apart if it is rare, and does not if half of all names have it."""
    assert alike("Foolano Ranch", "Foolano", [f"Place{i}" for i in range(400)]) < LEAST
    assert alike("Foolano Ranch", "Foolano", [f"Place{i} Ranch" for i in range(400)]) >= LEAST


def make(n, seed):
    r, rows = random.Random(seed), []
    for k in range(n):
        core = "".join(r.choice("bdgklmprst") + r.choice("aeiou") for _ in range(r.choice([2, 4, 4, 5])))
        kind, word = r.choice([("summit", "Peak"), ("spring", "Spring"), ("pass", "Pass")])
        mod = r.choice(["", "", "East ", "Big ", "Silver "])
        lon, lat = r.uniform(-110, -109.9), r.choice([40.0, 64.9]) + r.uniform(0, 0.05)
        for t_ in range(3):
            for _ in range(r.randint(0, 2)):
                c = list(core)
                for _ in range(r.choice([0, 0, 1, 2, 3])):
                    at = r.randrange(len(c))
                    c[at : at + r.choice([0, 1, 1, 2])] = r.choice("aeioubdg") * r.choice([0, 1, 1, 2])
                name = mod + "".join(c).title() + " " + r.choice([word, word[:2] if word != "Spring" else "Spg", ""])
                rows.append((t_, f"{t_}-{k}-{len(rows)}", name.strip(), kind, lon + r.gauss(0, 0.001), lat + r.gauss(0, 0.0006)))
    return rows


def test_like_all_pairs(spark):
    """No link of the all-pairs run is lost, none is added."""
    rows = make(220, 7)
    long = "".join(random.Random(1).choices("abdefgiklmnorstuz", k=100_000))
    odd = [(0, "x1", None, None, 1.0, 1.0), (1, None, "Foo Peak", "summit", -110.0, 40.0), (1, "x2", "Foo Peak", None, None, None), (2, "x3", "Foo Peak", "summit", 0.0, 0.0),
           (0, "x4", "N/A", "summit", -110.0, 40.0), (1, "x5", "-", "summit", -110.0, 40.0), (0, "x6", long, "summit", 5.0, 5.0), (1, "x7", long + "z", "summit", 5.0, 5.0),
           (0, "x8", "w " * 30_000, "summit", 6.0, 5.0), (1, "x9", "word " * 30_000, "summit", 6.0, 5.0)]
    df = spark.createDataFrame(rows + rows[:20] + odd, RECORD).selectExpr("*", "1 as c", "2 as n", "3 as bits", "4 as core", "5 as size")
    got = {(r["id_a"], r["id_b"]) for r in link_variants(df).collect()}
    assert ("x6", "x7") in got
    classes, _ = name_classes(df)
    rarity = F.lit(word_rarity(classes))
    all_pairs = spark.createDataFrame(rows, RECORD).distinct()
    side = lambda s: all_pairs.select(*(F.col(c).alias(f"{c}_{s}") for c in all_pairs.columns))
    near = haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")) <= REACH_M
    j = side("a").join(side("b"), (F.col("t_a") < F.col("t_b")) & (F.col("name_a") != F.col("name_b")) & near)
    want = {tuple(sorted(r)) for r in j.filter(t("NameAlike", F.col("name_a"), F.col("kind_a"), F.col("name_b"), F.col("kind_b"), rarity) >= LEAST).select("id_a", "id_b").collect()}
    got.discard(("x6", "x7"))
    assert got == want and len(want) > 200


def test_same_names_cost_nothing(spark):
    rows = [(t_, f"{t_}-{k}", "Foo Peak", "summit", -110.0, 40.0) for t_ in (0, 1) for k in range(9000)] + [(1, "v", "Foo Pk", "summit", -110.0, 40.0), (0, "u", "Fooo Pk", "summit", -110.0, 40.0)]
    df = spark.createDataFrame(rows, RECORD)
    classes, _ = name_classes(df)
    assert classes.count() == 4 and link_classes(classes).count() == 3 and classes.filter("ids is null").count() == 2
    assert link_variants(df).count() == 9000 + 9000 + 1


def test_empty(spark):
    assert link_variants(spark.createDataFrame([], RECORD)).count() == 0


ENTITY = "id string, name string, name_key string, kind string, lon double, lat double"


def test_entities(spark):
    a = [("g1", "East Bradolim Peak", "eastbradolimpeak", "summit", -110.0, 40.0), ("g2", "West Bradolim Peak", None, "summit", -110.003, 40.0), ("g3", "Spring", "spring", "spring", -110.0, 40.0), ("g4", None, "kolemata", None, -100.0, 40.0), ("g5", "Foo", "foo", "pass", None, 40.0), (None, "Foo", "foo", "pass", -110.0, 40.0)]
    b = [("n1", "Peak Bradolm, E.", None, "rock", -110.0005, 40.0), ("n2", "Bradolim Spring", "bradolimspring", "spring", -110.0005, 40.0), ("n3", "Spring", "spring", "spring", -110.0, 40.0), ("n4", "Kolemata", "kolemata", "pass", -100.001, 40.0), ("n5", "East Bradolim Peak", "eastbradolimpeak", "summit", -111.0, 40.0)]
    # Some matching pairs more: a calibration from two pairs proves little.
    more = [(f"m{k}", f"East {w} Peak", f"east{w}peak".lower(), "summit", -90.0 + k, 40.0) for k, w in enumerate("Albarno Belcrani Cordumel Dristova Elgramin Fordaski Gelminta Hirvandol".split())]
    x, y = spark.createDataFrame(a + a + more, ENTITY), spark.createDataFrame(b + [("w" + m[0], *m[1:]) for m in more], ENTITY).selectExpr("*", "1 as bits", "2 as rid", "3 as size")
    got = {(r["id_a"], r["id_b"]): r["confidence"] for r in match_entities(x, y).collect()}
    assert set(got) == {("g1", "n1"), ("g4", "n4")} | {(m[0], "w" + m[0]) for m in more} and all(0 <= c <= 1 for c in got.values())
    assert got["m0", "wm0"] > 0.8
    assert match_entities(x.limit(0), y).count() == 0 and match_entities(x, y.limit(0)).count() == 0


def test_hashing_finds_all_close_vectors(spark):
    """Every pair of vectors that differ in fewer than CHUNKS bits, and none twice."""
    r = random.Random(3)
    rows = []
    for k in range(400):
        v = r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64)
        for _ in range(3):
            x = v
            for _ in range(r.randint(0, 8)):
                x ^= 1 << r.randrange(64)
            rows.append((len(rows), x - (1 << 64) if x >> 63 else x, -110 + r.uniform(-0.0005, 0.0005), 40 + r.uniform(-0.0005, 0.0005)))
    df = spark.createDataFrame(rows, "n long, bits long, lon double, lat double")
    got = [tuple(x) for x in _pairs(df, df, 1400.0).collect()]
    want = {(p[0], q[0]) for p in rows for q in rows if ((p[1] ^ q[1]) & ((1 << 64) - 1)).bit_count() < CHUNKS}
    assert len(got) == len(set(got)) and set(got) == want


def test_confidence_is_the_true_share(spark):
    """Among pairs of like confidence, the share that truly belongs together is near it or above."""
    r, a, b = random.Random(11), [], []
    for k in range(1500):
        core = "".join(r.choice("bdgklmprst") + r.choice("aeiou") for _ in range(4))
        lon, lat = r.uniform(-110.1, -110), r.uniform(40, 40.1)
        typo = list(core)
        for _ in range(r.choice([0, 0, 1, 2])):
            typo[r.randrange(len(typo))] = r.choice("aeioubdg")
        a.append((f"a{k}", core.title() + " Peak", None, "summit", lon, lat))
        b.append((f"b{k}", "".join(typo).title() + " Peak", None, "summit", lon + r.gauss(0, 0.001), lat + r.gauss(0, 0.001)))
    out = match_entities(spark.createDataFrame(a, ENTITY), spark.createDataFrame(b, ENTITY)).collect()
    sure = [x for x in out if x["confidence"] >= 0.9]
    assert len(sure) > 1000 and sum(x["id_a"][1:] == x["id_b"][1:] for x in sure) / len(sure) >= 0.9
    assert sum(x["id_a"][1:] == x["id_b"][1:] for x in out) >= 1300


def test_calibration_rises():
    import numpy as np

    c = calibrate(np.array([100.0, 10, 200, 300]), np.array([300.0, 0, 60, 0]) * 0.3)
    assert (np.diff(c) >= 0).all() and c[-1] > 0.99 and c[0] < 0.5
    assert chance_of({50: 300, 85: 3}).sum() == pytest.approx(303 / 3)
