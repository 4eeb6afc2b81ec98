"""Packing, leaks and subjects: round trips, brute force and held-out accuracy."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoria.llm.leakage import find_leaks
from scoria.llm.packing import Windows, encoding, pack
from scoria.llm.subjects import Models, label_subjects, sentences, train, train_spread

DOCS = "doc_id bigint, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200), st.integers(1, 8))
def test_windows_never_overfill(sizes, most):
    w, used = Windows(100, most), defaultdict(int)
    for s in sizes:
        window, offset, _ = w.place(s)
        assert offset == used[window]
        used[window] += s
        assert used[window] <= 100 and len(w.free) <= most


def test_packing_round_trip(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choices(["tree", "river", "Stoß", "été", "12"], k=r.randint(0, 90)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, "word " * 1000), (403, "x" * 5000), (404, "é" * 3000), (None, "null key"), (5, "repeated"), (5, "repeated")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as size", "3 as window", "4 as container").repartition(3, "doc_id")
    out = pack(df, capacity=256, open_windows=4).collect()
    enc, want = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken"), defaultdict(int)
    for d, t in rows:
        want[d] += len(enc.encode_ordinary(t or ""))
    got, boxes = defaultdict(int), defaultdict(list)
    for x in out:
        got[x["doc_id"]] += x["tokens"]
        boxes[x["container"]].append((x["place"], x["tokens"]))
    assert got == want
    for items in boxes.values():
        at = 0
        for place, tokens in sorted(items):
            assert place == at
            at += tokens
        assert at <= 256
    assert {x["part"] for x in out if want[x["doc_id"]] <= 256 and x["doc_id"] not in (5, None)} <= {0}
    total = sum(want.values())
    assert len(boxes) <= total / 256 * 1.1 + 2
    assert pack(df.limit(0)).count() == 0


def passage(r, n=80):
    return " ".join(r.choices([f"w{k}" for k in range(40)], k=n // 2) + [f"rare{r.randrange(10**6)}" for _ in range(n // 2)])


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(4)
    items = [(k, " ".join(r.sample(p.split(), len(p.split())))) for k, p in ((k, passage(r)) for k in range(30))]
    docs, want = [], set()
    for k in range(300):
        text = " ".join(r.choices([f"w{i}" for i in range(40)] + [f"noise{i}" for i in range(500)], k=r.randint(10, 150)))
        if k % 3 == 0:
            i = r.randrange(30)
            p = items[i][1].split()
            share = r.choice([0.2, 0.25, 0.5, 0.7, 1.0])
            a = r.randrange(int(len(p) * (1 - share)) + 1)
            part = p[a : a + int(len(p) * share)]
            for _ in range(int(len(part) * 0.05)):
                part[r.randrange(len(part))] = "changed"
            part.insert(len(part) // 2, "(put, in between)")
            text = text + " " + " ".join(part).upper() + " " + text
            if share >= 0.5:
                want.add((k, i))
        docs.append((k, text))
    return items, docs, want


def test_leaks_found(spark, leaks):
    items, docs, want = leaks
    d = spark.createDataFrame(docs + docs[:9] + [(None, docs[0][1]), (900, None), (901, ""), (902, "w1 " * 200_000)], DOCS).selectExpr("*", "1 as doc", "2 as item", "3 as share")
    i = spark.createDataFrame(items + items[:3] + [(None, "x"), (77, None), (78, ""), (79, "too short")], "item_id bigint, passage string").selectExpr("*", "1 as text")
    got = [(r["doc_id"], r["item_id"]) for r in find_leaks(d, i).collect() if r["doc_id"] is not None]
    assert len(got) == len(set(got)) and set(got) == want
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_every_stretch_has_seeds(spark):
    """Items that share all their words, even whole passages, can still be found."""
    r = random.Random(5)
    same = [" ".join(r.choices("abcdefgh", k=60)) for _ in range(3)]
    items = spark.createDataFrame([(k, same[k % 3]) for k in range(30)], "item_id bigint, passage string")
    docs = [(100 * k + a, " ".join(same[k].split()[a : a + 24])) for k in range(3) for a in range(37)]
    got = {tuple(x) for x in find_leaks(spark.createDataFrame(docs, DOCS), items).select("doc_id", "item_id").collect()}
    assert {(d, k) for d, _ in docs for k in range(30) if k % 3 == d // 100} <= got


def test_short_items_and_stretches(spark):
    """Items and stretches shorter than the longest mask: two fifths in one run are found, less are not."""
    items = [(1, "six whole words make this item"), (2, "alpha beta gamma delta eps zeta eta theta"), (3, " ".join(f"n{i}" for i in range(15))), (4, "lone"), (5, "two words")]
    docs = [
        (1, "so: Six WHOLE words, make this item!"), (2, "x alpha beta gamma delta y"), (3, "x beta gamma y z theta"), (4, " ".join(f"n{i}" for i in range(4, 10)) + " end"),
        (5, "n1 n2 n3 n4 n5 and so on"), (6, "a lone wolf"), (7, "aloneness"), (8, "only two here"), (9, "six other words"),
    ]
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    got = {tuple(x) for x in find_leaks(spark.createDataFrame(docs, DOCS), i).select("doc_id", "item_id").collect()}
    assert got == {(1, 1), (1, 5), (2, 2), (4, 3), (6, 4), (8, 5), (9, 5)}  # of two words, one is half


def test_any_stretch_of_two_fifths(spark):
    """Every start and length of a quotation of two fifths or more, by brute force; items of all lengths."""
    r, docs, want = random.Random(8), [], set()
    items = [(n, [f"v{n}x{i}" if r.random() < 0.4 else r.choice("abcdefghij") for i in range(n)]) for n in range(3, 60)]
    for n, p in items:
        need = -(-2 * n // 5)
        for a in range(0, n - need + 1, max(1, n // 9)):
            docs.append((len(docs), " ".join(["q", "r"] + p[a : a + need] + ["s"])))
            want.add((docs[-1][0], n))
    i = spark.createDataFrame([(n, " ".join(p)) for n, p in items], "item_id bigint, passage string")
    got = {tuple(x) for x in find_leaks(spark.createDataFrame(docs, DOCS), i).select("doc_id", "item_id").collect()}
    assert want <= got


def test_sentences():
    assert [len(s) for s in sentences("One two. <b>Three four</b> 84.5!\nA b c · d e\n\nx")] == [2, 4, 3, 2]
    assert sentences("") == [] and sentences("<div></div>") == [] and sentences("Élan vital 12")[0] == ["elan", "vital", "#"]


SUBJECTS = {"rock": "granite basalt cliff schist moraine", "law": "permit court fine statute appeal", "sport": "race lap winner sprint climb"}
FILLER = ["the bus was late again today", "see the board for details please", "we had lunch and walked back"]


def corpus(n, seed):
    r, rows = random.Random(seed), []
    for k in range(n):
        about = r.sample(sorted(SUBJECTS), r.choice([0, 1, 1, 2]))
        lines = [f"the {r.choice(SUBJECTS[a].split())} near {r.choice(SUBJECTS[a].split())} was number {r.randrange(99)}" for a in about for _ in range(3)]
        lines += [r.choice(FILLER) for _ in range(r.randint(1, 3))]
        r.shuffle(lines)
        rows.append((k, ". ".join(lines) + ".", set(about) if all(3 / len(lines) >= 0.25 for _ in about) else set()))
    return rows


def test_subjects_held_out(spark):
    rows = corpus(500, 6)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(0, rows[0][1]), (9000, None), (9001, ""), (9002, "word " * 300_000), (None, "x y z.")], DOCS).selectExpr("*", "1 as noted", "2 as subject_code")
    labels = spark.createDataFrame([(k, s, "r") for k, _, about in rows[:200] for s in (about or {"none"})] + [(3, None, "r"), (None, "law", "r")], "doc_id bigint, subject_code string, reader string")
    subjects = spark.createDataFrame([(s, "") for s in SUBJECTS] + [(None, "")], "subject_code string, description string")
    got = [(r[0], r[1]) for r in label_subjects(docs, labels, subjects).collect()]
    assert len(got) == len(set(got))
    want = {(k, s) for k, _, about in rows[200:] for s in about}
    said = {x for x in got if 200 <= x[0] < 500}
    f1 = 2 * len(want & said) / (len(want) + len(said))
    assert f1 >= 0.95, f1
    assert label_subjects(docs.limit(0), labels, subjects).count() == 0 and label_subjects(docs, labels.limit(0), subjects).count() == 0
    assert label_subjects(docs, labels, subjects.limit(0)).count() == 0


def test_training_without_labels_of_a_subject():
    m = train([sentences("a b c. d e f.")], [{"none"}], ["law"])
    assert list(m.subjects_of([sentences("a b c."), []])) == []


def test_models_of_all_labelled_documents(spark):
    """No count or length of labelled documents is left out: the models are those of one fit over all, however they are parted."""
    rows = [(k, f"word{k // 2} near granite. {SUBJECTS['law'] if k % 3 else SUBJECTS['rock']}.", ["law" if k % 3 else "rock"]) for k in range(12_600)]
    rows.append((20_000, ("the race was long. " + SUBJECTS["sport"] + ". ") * 3_000, ["sport"]))  # of 150,000 characters
    codes = sorted(SUBJECTS)
    whole = Models(codes).fit([sentences(t) for _, t, _ in rows], [set(n) for _, _, n in rows])
    assert "word6299" in whole.words and "sprint" not in Models(codes).fit([sentences(rows[0][1])], [{"rock"}]).words
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, noted array<string>")
    for parts in (3, 7):
        got = train_spread(labelled.repartition(parts), codes)
        assert got.words == whole.words and all((getattr(got, x) == getattr(whole, x)).all() for x in ("pairs", "uni", "bi"))


def test_subject_of_long_texts_only(spark):
    """A subject that readers noted in texts over 100,000 characters only is learnt from them."""
    rows = [(k, t, about) for k, t, about in corpus(300, 7) if not any(w in t for w in SUBJECTS["sport"].split())]
    sport = ". ".join(f"the {a} near {b} was number 7" for a in SUBJECTS["sport"].split() for b in SUBJECTS["sport"].split())
    long = [(1000 + k, f"{sport}. {'<br>' * 30_000}{FILLER[k % 3]}.", {"sport"}) for k in range(6)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows + long] + [(5000, sport)], DOCS)
    labels = spark.createDataFrame([(k, s, "r") for k, _, about in rows + long for s in (about or {"none"})], "doc_id bigint, subject_code string, reader string")
    subjects = spark.createDataFrame([(s, "") for s in SUBJECTS], "subject_code string, description string")
    got = {tuple(r) for r in label_subjects(docs, labels, subjects).collect()}
    assert {(5000, "sport"), *((k, "sport") for k, _, _ in long)} <= got
