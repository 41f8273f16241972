"""Corpus operators do the whole job: nothing grows past a size at which cases are dropped."""

import random

from wakeline.llm import encoding, near_duplicates, pairs


def test_copies_of_a_garbled_text_do_not_vouch_for_it(spark):
    r = random.Random(5)
    every = "Käufer wählt schöne Café über Brücke Señor está aquí niño fenêtre déjà fermée Noël für Gerät qué der die das une por plain words".split()
    clean = [" ".join(r.choice(every) for _ in range(12)) for _ in range(2000)]
    bad = "Größter Gemüsehändler verkäuft süßsäuerliche Äpfel".encode().decode("latin-1")
    for copies in ([bad] * 1000, [f"{bad} {i}" for i in range(1000)]):  # a third of all rows, equal or nearly
        d = spark.createDataFrame([*enumerate(clean), *enumerate(copies, 1000)], "doc_id bigint, text string")
        got = {x["doc_id"]: x["restored"] for x in encoding.garbled(d).collect()}
        assert got == {1000 + i: s.encode("latin-1").decode() for i, s in enumerate(copies)}


def test_rare_ends_of_sentences_are_told_in_a_large_vocabulary(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    noise = [" ".join(word() for _ in range(200)) + "." for _ in range(12_000)]  # about 9 million runs, none of which ends a sentence but the last
    asked = [" ".join(word() for _ in range(6)) for _ in range(300)]
    # each last word ends sentences eight times; runs of four are seen once, and must not be taken for more
    known = [f"{word()} {word()} {word()} {a.split()[-1]}." for a in asked for _ in range(8)]
    d = spark.createDataFrame([(i, "", a) for i, a in enumerate(asked)] + [(1000 + i, "", a) for i, a in enumerate(noise + known)], "id bigint, p string, a string")
    assert pairs.broken_pairs(d, "id", "p", "a").filter("defect = 'truncated'").count() == 0


def test_large_classes_give_all_pairs(spark):
    r = random.Random(9)
    w = [f"w{i}" for i in range(10)]
    d = spark.createDataFrame([(i, " ".join(r.sample(w, 10))) for i in range(65)] + [(100, " ".join(w[:9]))], "id bigint, a string")
    got = {(x["a"], x["b"]) for x in near_duplicates.similar_pairs(*near_duplicates.similar_classes(d, "id", ["a"], 0.6)).collect()}
    ids = [*range(65), 100]
    assert got == {(x, y) for x in ids for y in ids if x < y}


def test_blocks_are_bounded_at_any_size():
    for rows in (0, 10_000, 400_000, 10**7, 10**9):
        n = near_duplicates._blocks(rows, 36.0, 24_000, 480_000)
        assert rows * min(36, n) / n <= 500_000


def test_words_spread_over_blocks_lose_no_pair(spark):
    r = random.Random(11)
    common, names = [f"c{i}" for i in range(40)], [f"n{i}" for i in range(400)]
    rows = [set(r.sample(common, 18)) | set(r.sample(names, 6)) for _ in range(300)]
    rows += [set(r.sample(sorted(x), 20)) | {r.choice(names)} for x in r.sample(rows, 200)]
    d = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(rows)], "id bigint, a string")
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(rows[i] & rows[j]) >= 0.6 * len(rows[i] | rows[j]) - 1e-9}
    for word, task in ((50_000, 480_000), (20, 200)):
        got = near_duplicates.similar_pairs(*near_duplicates.similar_classes(d, "id", ["a"], 0.6, rows_per_block=50, rows_per_word=word, rows_per_task=task)).collect()
        assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)


def _garble(text, written, read):
    return text.encode(written).decode(read, errors="replace")


def test_garbled_texts_are_restored_as_they_were(spark):
    """Texts of the corpus that are clean, garbled by the test: what is found and how much comes back word for word."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bad = {x["doc_id"] for x in encoding.garbled(d).select("doc_id").collect()}
    clean = {x["doc_id"]: x["text"] for x in d.collect() if x["doc_id"] not in bad and x["text"] and not x["text"].isascii()}
    ways = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850")]
    picked = sorted(clean)[::20]
    rows = [(i, _garble(t, *ways[i % 4]) if i in picked else t) for i, t in clean.items()]
    got = {x["doc_id"]: x["restored"] for x in encoding.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == set(picked)
    whole = [i for i in picked if encoding.LOST not in dict(rows)[i]]
    assert len(whole) > 20 and sum(got[i] == clean[i] for i in whole) >= 0.97 * len(whole)
    lost = [i for i in picked if i not in whole]
    same = [(a == b) for i in lost for a, b in zip(got[i].split(" "), clean[i].split(" "), strict=False)]
    assert not lost or sum(same) >= 0.9 * len(same)


def test_exact_search_finds_no_better_reading_missed(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some, every = (sorted(map(tuple, encoding.garbled(d, **k).collect())) for k in ({}, {"beam": None, "readings": (None, None)}))
    assert [x[0] for x in some] == [x[0] for x in every] and sum(a == b for a, b in zip(some, every, strict=True)) >= 0.95 * len(some)


def test_language_models_come_from_all_texts(spark):
    import re

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("lang", "substr(text, 1, 90) AS text")
    rows = spark.createDataFrame([(f"Say how the taste of reader {i} grows.", "Der Leser kauft zuerst einen Roman und danach weitere Bücher." if i % 9 == 0 else "The reader first buys a novel and then other books.") for i in range(60)], "p string, a string")
    labels = [(re.match(r"([a-z]{2,3})(?:[-_]|$)", x["lang"].strip().lower()), x["text"]) for x in docs.collect() if x["lang"] and x["text"]]
    want = pairs.train_languages([(m[1], t) for m, t in labels if m], [t for x in rows.collect() for t in (x["p"], x["a"])])
    got = pairs.learn_languages(docs, rows)
    assert got.names == want.names and got.grams.keys() == want.grams.keys()
    assert all(np.array_equal(got.grams[g], w) for g, w in want.grams.items())
    assert np.abs(got.usual - want.usual).max() < 1e-3
    assert pairs.learn_languages(docs, rows, most=500).grams.keys() == want.grams.keys()


def test_rounds_bound_the_copies_on_disk_and_lose_no_pair(spark):
    for rows in (10, 10_000, 400_000, 8_400_000, 10**9):
        b = near_duplicates._blocks(rows, 37.0, 24_000, 480_000)
        k = near_duplicates._rounds(b, 37.0, 8)
        assert b * (1 - (1 - 1 / b) ** 37) / k <= 8 and k <= 5
    r = random.Random(4)
    rows = [set(r.sample(range(90), 24)) for _ in range(150)]
    rows += [set(r.sample(sorted(x), 21)) | {r.randrange(90, 99)} for x in r.sample(rows, 120)]
    d = spark.createDataFrame([(i, " ".join(f"w{x}" for x in ws)) for i, ws in enumerate(rows)], "id bigint, a string")
    want = {(i, j) for j in range(len(rows)) for i in range(j) if rows[i] != rows[j] and len(rows[i] & rows[j]) >= 0.6 * len(rows[i] | rows[j]) - 1e-9}
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for at_once in (2, 100):
        links = near_duplicates.similar_classes(d, "id", ["a"], rows_per_block=20, copies_at_once=at_once)[1]
        assert {(x["rep_a"], x["rep_b"]) for x in links.collect()} == want and len(want) >= 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
