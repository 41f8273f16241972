"""Operators on texts and terms against plain versions; nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from wakeline.llm import encoding, leakage, mixing, near_duplicates, pairs, sequences, term_counts
from wakeline.llm.text import words


def test_terms_against_counts(spark):
    r = random.Random(2)
    spell = lambda w: r.choice([w, w.upper(), w.replace(" ", "_"), w.replace(" ", " - "), f"\t{w} "])
    data = [(i, [spell(r.choice(["a b", "c", "d e", "hot"])) for _ in range(r.randint(0, 5))] + ["hot"], i) for i in range(60)]
    data += [(1, data[1][1], 0), (90, None, 0), (91, [None, "", " _ "], 0), (None, ["hot"], 0), (92, ["once"], 0)]
    d = spark.createDataFrame(data, "id bigint, kw array<string>, records bigint")
    want: dict = defaultdict(set)
    for i, ks, _ in data:
        for k in ks or []:
            t = " ".join((k or "").lower().replace("_", " ").replace("-", " ").split())
            if t and i is not None:
                want[t].add(i)
    for rows in (4_000_000, 2):  # the second spills again and again
        got = {x["term"]: x for x in term_counts.term_frequencies(d, "id", "kw", bits=2, partition_rows=rows).collect()}
        assert {t: x["records"] for t, x in got.items()} == {t: len(s) for t, s in want.items()}
    assert got["once"]["band"] == "rare" and got["hot"]["band"] == "common" and got["hot"]["occurrences"] >= got["hot"]["records"]
    assert term_counts.term_frequencies(d.limit(0), "id", "kw").count() == 0


def _patterns(seqs, gap, lo, hi):
    found = Counter()
    for q in seqs.values():
        own = set()

        def grow(p, at, q=q, own=own):
            if len(p) >= lo:
                own.add(p)
            if len(p) < hi:
                for j in range(at + 1, min(at + gap, len(q) - 1) + 1):
                    grow((*p, q[j]), j)

        for i, s in enumerate(q):
            grow((s,), i)
        found.update(own)
    return found


@pytest.mark.parametrize("per_task", [4000, 7])
def test_sequences_against_enumeration(spark, per_task):
    r = random.Random(4)
    seqs = {f"u{i}": [r.choice("ABCD") for _ in range(r.randint(1, 8))] for i in range(40)} | {"hot": [r.choice("ABCD") for _ in range(300)]}
    data = [(u, w, s, "") for u, q in seqs.items() for w, s in enumerate(q)]
    d = spark.createDataFrame([*data, *data[:20], (None, 1, "A", ""), ("u1", None, "A", ""), ("u1", 99, None, "")], "u string, w int, s string, entities string")
    got = {tuple(x["pattern"]): x["entities"] for x in sequences.frequent_sequences(d, "u", "w", "s", 3, 0.3, entities_per_task=per_task).collect()}
    need = 13  # 30 % of 41
    assert got == {p: n for p, n in _patterns(seqs, 3, 2, 4).items() if n >= need}
    assert sequences.frequent_sequences(d.limit(0), "u", "w", "s").count() == 0


def test_states_of_few_entities_take_no_bit_vector():
    import pyarrow as pa

    rows = [(f"u{i:03}", s) for i in range(100) for s in ("A", f"own{i}")]
    batch = pa.record_batch([pa.array([u for u, _ in rows]), pa.array([s for _, s in rows])], names=["entity", "state"])
    maps, starts = sequences._bitmaps([batch], 3, lambda n: n // 50, None)
    assert set(maps) == {"A"} and len(starts) == 100
    assert set(sequences._bitmaps([batch], 3, lambda n: 1, {"own7"})[0]) == {"own7"}


def test_myers_against_dynamic_programming():
    r = random.Random(6)
    for _ in range(200):
        p, t = [r.choice("abc") for _ in range(r.randint(1, 9))], [r.choice("abc") for _ in range(r.randint(0, 15))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert leakage.myers(p, t, 99)[0] == (best if t else 100)
    assert leakage.pieces(13, 1) == [(0, 6), (6, 13)]


def test_leaks(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = {i: text(30) for i in range(6)}
    docs = {i: text(60) for i in range(30)}
    for d, (i, a, n) in {1: (0, 3, 13), 2: (1, 0, 12), 3: (2, 0, 30), 4: (3, 10, 20)}.items():
        docs[d] = [*docs[d][:20], *items[i][a : a + n], *docs[d][20:]]
    broken = list(items[4][:13])
    broken[5] = "other"
    docs[5] = [*docs[5], *broken]
    rows = [(k, " ".join(v).upper() + ".", 0) for k, v in docs.items()] + [(3, " ".join(docs[3]), 0), (77, None, 0), (78, "", 0), (None, "x", 0), (79, " ".join(text(20_000) + items[5]), 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, eval_id int")
    e = spark.createDataFrame([(k, ", ".join(v)) for k, v in items.items()] + [(9, "short one"), (10, None), (None, "x")], "eval_id bigint, passage string")
    want = {(k, i) for (k, v), (i, w) in product([*docs.items(), (79, words(rows[-1][1]))], items.items()) if any(" ".join(w[a : a + 13]) in " ".join(v) for a in range(18))}
    both = [sorted(map(tuple, leakage.leaked_items(d, e, automaton_items=n).collect())) for n in (20_000, 2)]
    assert both[0] == both[1]  # by automaton, and by a join on pieces
    for n in (20_000, 2):
        got = leakage.leaked_items(d, e, automaton_items=n).collect()
        assert {(x["doc_id"], x["eval_id"]) for x in got if x["distance"] == 0} == want
        assert {(x["doc_id"], x["eval_id"], x["distance"]) for x in got if x["distance"]} == {(5, 4, 1)} | {(x["doc_id"], x["eval_id"], 1) for x in got if x["doc_id"] == 2}
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0


def test_planted_edits_are_found_at_their_distance(spark):
    """Passages with a word changed, dropped or put in, against every stretch of every document by dynamic programming."""
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(200)]
    items = {i: [r.choice(vocab) for _ in range(16)] for i in range(20)}
    docs = {}
    for d in range(60):
        w = list(items[d % 20][:13] if d % 3 else items[d % 20])
        for _ in range(d % 4):
            at = r.randrange(1, len(w) - 1)
            w[at : at + r.choice([0, 1])] = r.choice([[], ["new"]])
        docs[d] = [r.choice(vocab) for _ in range(10)] + w + [r.choice(vocab) for _ in range(10)]

    def least(p, t):
        row, best = list(range(len(p) + 1)), len(p)
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        return best

    want = {}
    for d, t in docs.items():
        for i, w in items.items():
            ds = [least(w[a : a + 13], t) for a in range(4)]
            if min(ds) <= 1:
                want[d, i] = (min(ds), sum(x <= 1 for x in ds))
    ds, es = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "eval_id bigint, passage string")
    for n in (20_000, 2):
        got = {(x["doc_id"], x["eval_id"]): (x["distance"], x["spans"]) for x in leakage.leaked_items(ds, es, automaton_items=n).collect()}
        assert got == want and {v[0] for v in got.values()} == {0, 1}


def test_water_filling():
    have, share, most = {"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 3, "c": 5}
    e = mixing.water_fill(have, share, most, 100)
    assert e["b"] == 3 and e["c"] == 0 and e["a"] == pytest.approx(0.7)
    assert mixing.water_fill(have, share, most, 10_000) == {"a": 2.0, "b": 3.0, "c": 0.0}
    assert mixing.largest_exact_total({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == 40


def test_mix_reaches_shares_and_caps(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), r.choice(["A x", "a-X ", "b"]), 0) for i in range(400)]
    rows += [rows[0], (500, None, "b", 0), (None, "x", "b", 0), (501, "x", None, 0), (502, "", "b", 0), (503, "y", "other", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("a_x", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    members, report = mixing.mix(d, t)
    got = {x["source"]: x for x in report.collect()}
    assert all(abs(x["actual_share"] - 0.5) < 0.01 for x in got.values())
    m = members.collect()
    assert len({x["doc_id"] for x in m}) == len(m) and all(x["copies"] <= {"a_x": 1, "b": 3}[x["source"]] for x in m)
    assert {s: sum(x["tokens"] * x["copies"] for x in m if x["source"] == s) for s in got} == {s: x["used_tokens"] for s, x in got.items()}
    capped = {x["source"]: x for x in mixing.mix(d, t, total_tokens=1e9)[1].collect()}
    assert capped["a_x"]["epochs"] == 1 and capped["b"]["epochs"] == 3
    part = {x["source"]: x for x in mixing.mix(d, t, share_of_caps=0.9)[1].collect()}
    all_ = sum(x["max_repeats"] * x["tokens"] for x in part.values())
    assert max(x["epochs"] / x["max_repeats"] for x in part.values()) == 1 and abs(sum(x["used_tokens"] for x in part.values()) - 0.9 * all_) < 200
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[1].count() == 0


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251")])
def test_encoding_round_trip(spark, written, read):
    clean = ["Der Käufer wählt das schöne Café über der Brücke", "Señor, ¿por qué está aquí el niño?", "L’été, la fenêtre était déjà fermée à Noël", "Naïve? Maybe – €20 for the “Café”"] * 30
    bad = {1000: "Das Gerät für die schöne Brücke", 1001: "plain words then ¿por qué está aquí? and plain words"}
    garble = lambda s: s.encode(written).decode(read, errors="replace")
    rows = [(i, s, "") for i, s in enumerate(clean)] + [(i, garble(s), "") for i, s in bad.items()] + [(1000, garble(bad[1000]), ""), (7000, None, ""), (7001, "", ""), (None, garble("é"), ""), (7002, "ascii " * 50_000, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = {x["doc_id"]: x for x in encoding.garbled(d).collect()}
    assert set(got) == set(bad)
    if encoding.LOST not in garble("".join(bad.values())):
        assert {i: x["restored"] for i, x in got.items()} == bad
    assert encoding.garbled(d.limit(0)).count() == 0


def test_lost_bytes_are_found_and_cyrillic_restored(spark):
    ru = ["покупатель пользователь коробка загадки появились странные песни из раздела"] * 40 + ["Die Brücke im schönen Café"] * 40
    rows = [*enumerate(ru), (500, "пользователь коробка загадки появились".encode("cp1251").decode("latin-1")), (501, "Die Brücke".encode("cp1252").decode("utf-8", errors="replace"))]
    got = {x["doc_id"]: x for x in encoding.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {500, 501}
    assert got[500]["restored"] == "пользователь коробка загадки появились" and got[501]["restored"] == "Die Brücke"


PROMPT = "Items taken in this order:\n1. Red Harbor [noir] purchase\n2. Die Brücke [folk] purchase\nWhat does this window show about the user?"
GOOD = "The user opens with Red Harbor, a quiet title known for framing. Each harbor is bought on a Monday."
CASES = {
    "empty": [None, "", "  \n", "N/A", "{}", "null", "-"],
    "refusal": ["I'm sorry, but I cannot help with that.", "As an assistant I have to pass on this one.", "The list names Red Harbor. Unfortunately I must decline to profile an individual.", "My guidelines do not permit summarizing such records. Please ask again."],
    "copied": [PROMPT, "Sure. " + PROMPT.replace("\n", " "), "1. Red Harbor [noir] purchase\n2. Die Brücke [folk] purchase"],
    "language": ["Über mehrere Wochen hinweg wächst das Interesse an Klängen, während die Liste kaum noch gehört wird.", "Сначала в корзине была книга, затем появились песни."],
    "truncated": ["The user opens with Red Harbor, a quiet title known for", "The user opens with Red Har", "It ends with (a quiet", "Both share a view of the cellar, so ..."],
    None: [GOOD, GOOD[:-1], GOOD + " I am sorry to see so little variety.", "Only Die Brücke matters here.", "A framing fan."],
}


def test_pairs(spark):
    cases = [(d, a) for d, xs in CASES.items() for a in xs]
    rows = [(i, PROMPT, a, "") for i, (_, a) in enumerate(cases)] + [(900 + i, PROMPT, GOOD, "") for i in range(40)] + [(2000, None, GOOD, ""), (None, PROMPT, "", ""), (0, PROMPT, None, ""), (2001, PROMPT, "Each harbor is bought on a Monday. " * 3000, "")]
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {x["id"]: x["defect"] for x in pairs.broken_pairs(spark.createDataFrame(rows, "id bigint, p string, a string, defect string"), "id", "p", "a", labelled).collect()}
    assert got == {i: d for i, (d, _) in enumerate(cases) if d}
    for given in (labelled, labelled.limit(0), None):
        assert pairs.broken_pairs(spark.createDataFrame([], "id bigint, p string, a string"), "id", "p", "a", given).count() == 0


REFUSALS = [
    "Dat kan ik helaas niet voor je doen.",
    "Het spijt me, maar ik kan deze vraag niet beantwoorden.",
    "Mi dispiace, ma non posso rispondere a questa domanda.",
    "Non sono in grado di aiutarti con questa richiesta.",
    "很抱歉，我无法回答这个问题。",
    "I'd prefer not to answer that.",
    "That is not something I can help with.",
    "This request is outside what I can discuss.",
    "I won't be answering this one.",
    "Nie mogę odpowiedzieć na to pytanie.",
    "Bu soruyu yanıtlayamam.",
    "Eso no puedo hacerlo.",
    "Je refuse de répondre.",
    "Ich kann diese Frage leider nicht beantworten.",
    "Não posso ajudar com esse pedido.",
    "К сожалению, я не могу ответить на этот вопрос.",
]
ANSWERS = [
    "The reader cannot decide between jazz and folk.",
    "I bought this for my sister, who does not like horror.",
    "We see no change of taste in these items.",
    "The buyer will not return to crime; instead drama wins.",
    "Sorry Tailor opens the list and then folk follows.",
    "Nothing in the list is repeated, and the taste moves on.",
    "Der Käufer kann sich nicht entscheiden.",
]


def test_refusals_nobody_planted():
    assert [a for a in REFUSALS if not pairs.is_refusal(a)] == []
    assert [a for a in ANSWERS if pairs.is_refusal(a)] == []


def test_languages_the_sample_does_not_hold():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    m = pairs.train_languages([(x["lang"].strip().lower()[:2], x["text"]) for x in rows if x["lang"] and x["text"]], [])
    said = "Say in one or two sentences how the preference of the reader develops and what the list shows."
    other = [
        "De gebruiker koopt eerst een roman en gaat daarna over op andere boeken uit dezelfde reeks.",
        "Användaren köper först en roman och går sedan vidare till andra böcker.",
        "Użytkownik najpierw kupuje powieść, a potem przechodzi do innych książek.",
        "Kullanıcı önce bir roman alıyor, sonra başka kitaplara geçiyor.",
        "Ο χρήστης αγοράζει πρώτα ένα μυθιστόρημα.",
        "Il lettore compra prima un romanzo e poi passa ad altri libri della stessa serie.",
    ]
    assert [a for a in other if not m.other(said, a)] == []
    assert not m.other(said, "The reader first buys a novel and then moves on to other books of the same series.")
    assert not pairs.Languages({}).other(said, other[0]) and pairs.Languages({}).other(said, other[4])


def test_tiles_take_the_longest_first():
    a, b = "x a b c d y e f g".split(), "e f g z a b c d".split()
    assert sorted(pairs.tiles(a, b)) == [(1, 4, 4), (6, 0, 3)]
    assert pairs.open_constructs("a (b [c] \"d") == [")", '"'] and pairs.open_constructs("```js {}```") == []


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_near_duplicates_against_all_pairs(spark, t):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(150)]
    base = [r.sample(vocab, r.randint(1, 40)) for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 8)):
            if r.random() < 0.5 and len(w) > 1:
                w.pop(r.randrange(len(w)))
            else:
                w.insert(r.randrange(len(w) + 1), r.choice(vocab))
        rows.append((i, " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]) or None, 0))
    rows += [rows[0], (900, None, None, 0), (901, "", "!", 0), (None, "w1", "w2", 0)] + [(1000 + i, "same text of many", "copies", 0) for i in range(70)]
    d = spark.createDataFrame(rows, "id bigint, a string, b string, rep int")
    classes, links = near_duplicates.similar_classes(d, "id", ["a", "b"], t)
    got = {(x["a"], x["b"]) for x in near_duplicates.similar_pairs(classes, links).collect()}
    sets = {i: set(words(f"{a or ''} {b or ''}")) for i, a, b, _ in rows if i is not None}
    ids = sorted(i for i in sets if i < 1000)
    want = {(x, y) for x in ids for y in ids if x < y and sets[x] and len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y]) - 1e-9}
    assert {p for p in got if p[1] < 1000} == want
    assert {p for p in got if p[1] >= 1000} == {(1000, 1000 + i) for i in range(1, 70)}  # many copies: a star
    groups = {x["key"]: x for x in near_duplicates.duplicate_groups(classes, links).collect()}
    assert len(groups) == len(ids) - 2 + 70
    for x, y in want:
        assert groups[x]["group_key"] == groups[y]["group_key"]
    assert near_duplicates.similar_classes(d.limit(0), "id", ["a", "b"])[1].count() == 0


@pytest.mark.parametrize("direct", [(0, 4, 8, 8, 8), (0, 2, 2, 2, 2), near_duplicates.DIRECT])
def test_near_duplicate_blocks_lose_nothing_in_crowded_groups(direct):
    """Groups over every limit of direct multiplication still give all pairs."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([np.arange(12), r.choice(np.arange(12, 60), 28, replace=False)])).astype(np.uint32) for _ in range(200)]
    rows = [x[r.permutation(len(x))[: len(x) - r.integers(0, 5)]] for x in rows]
    rows = [np.sort(x) for x in rows]
    n = np.array([len(x) for x in rows])
    bits = np.zeros((len(rows), 256), bool)
    for i, x in enumerate(rows):
        bits[i, near_duplicates._mix(x) >> np.uint64(56)] = True
    sig = np.packbits(bits, axis=1).view(np.uint64)
    b = near_duplicates._Block(0.6, np.arange(len(rows)), n, np.zeros(len(rows), np.int64), n, np.concatenate(rows), sig)
    b.work(*b.entries(lambda w, k: np.ones(len(w), bool)), 1, direct)
    got = set(zip(*(x.tolist() for x in b.result()), strict=True))
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(np.intersect1d(rows[i], rows[j])) >= 0.6 * len(np.union1d(rows[i], rows[j])) - 1e-9}
    assert want and want <= got


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)] + [(r.randint(200, 230), r.randint(200, 230)) for _ in range(20)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
    assert near_duplicates.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
    assert F is not None
