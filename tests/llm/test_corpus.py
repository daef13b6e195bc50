import pickle
import random
import re

import numpy as np
import pytest

from sijill.llm import leakage as K
from sijill.llm import packing as P
from sijill.llm import splitting as S
from sijill.llm import toxicity as X
from tests.compare import assert_same, duck


# --- splitting
def test_pieces_cover_and_overlap():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["كلمة ", "نص. ", "سطر\n", "x" * 40, "عنوان\r\n", "1: بند؛ "]) for _ in range(rng.randint(1, 400)))
        tree = S.StructureTree(text, 300, 50)
        at = 0
        for start, fresh, end in tree.pieces():
            assert text[at:fresh].strip() == "" and 0 < end - fresh <= 250 and end - start <= 300 and fresh - start == min(50, fresh)
            at = end
        assert text[at:].strip() == ""
        lines = re.split(r"\r?\n", text)
        assert (tree.boundary == "line") == (max(map(len, lines)) <= 250)


@pytest.mark.parametrize("text, want", [("سطر\n" * 600, "line"), ("جملة قصيرة. " * 300, "sentence"), ("كلمة " * 600, "word"), ("x" * 3000, "none"), ("x" * 2000 + "\n" + "سطر\n" * 5, "none")])
def test_boundary(text, want):
    tree = S.StructureTree(text)
    tree.pieces()
    assert tree.boundary == want


def test_sections_stay_together():
    text = "\n".join(f"عنوان {i}\n" + "1: بند طويل بعض الشيء في القسم.\n" * 20 for i in range(4))
    starts = [text[f:].split("\n")[0] for _, f, _ in S.StructureTree(text, 900, 100).pieces()]
    assert starts == [f"عنوان {i}" for i in range(4)]


def test_headings_and_items_nest():
    text = "الباب الأول\nالفصل الأول\nنص.\n1- بند\nتتمة البند.\n2- بند آخر\nالفصل الثاني\nنص.\n# باب\nسطر."
    tree = S.StructureTree(text, 40, 5).tree()
    show = lambda n: (text[n.start : n.end].split("\n")[0], [show(c) for c in n.children if c.level < S.PLAIN])
    assert [show(c) for c in tree.children] == [("الباب الأول", [("الفصل الأول", [("1- بند", []), ("2- بند آخر", [])]), ("الفصل الثاني", [])]), ("# باب", [])]


def test_an_opened_section_does_not_run_into_the_next():
    text = "الفصل الأول\n" + "سطر من النص.\n" * 40 + "الفصل الثاني\nسطر."
    ends = [text[f:e] for _, f, e in S.StructureTree(text, 300, 50).pieces()]
    assert ends[-1].startswith("الفصل الثاني")


def test_split_texts_edges(spark):
    df = spark.createDataFrame([(1, "x" * 1400, 0), (2, "x" * 1401, 0), (2, "x" * 1401, 0), (3, None, 0), (4, "", 0)], "id long, t string, pieces int")
    assert [(r.row_key, r.boundary, len(r.pieces)) for r in S.split_texts(df, "id", "t").collect()] == [(2, "none", 2)] * 2
    assert S.piece_texts(df, "id", "t").count() == 4 and S.split_texts(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        S.StructureTree("a", 10, 10)


def test_p7_against_sql(spark, medium):
    assert_same(S.p7_found(spark, medium), duck(medium), S.P7_SQL)


# --- packing
def optimum(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(120):
        sizes = sorted((rng.randint(5, 70) for _ in range(rng.randint(1, 8))), reverse=True)
        bins = P.BinCompletion(sizes, 100).solve()
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) == optimum(sizes, 100)


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(7)
    for _ in range(150):
        sizes = [rng.randint(5, 90) for _ in range(rng.randint(1, 8))]
        assert P.lower_bound(sizes, 100) <= optimum(sizes, 100)
    assert P.lower_bound([51, 51, 49, 48], 100) == 2 and P.lower_bound([60, 60, 45, 45], 100) == 3


def test_search_beats_best_fit_where_that_misses_the_bound():
    rng = random.Random(1)
    sizes = [rng.randint(300, 900) for _ in range(400)]
    solver = P.BinCompletion(sizes, 2048)
    before = len(solver.best)
    bins = solver.solve()
    assert before > solver.bound and len(bins) <= before and sorted(i for b in bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)


def test_dominance():
    assert P.dominates((60, 40), (50, 40)) and P.dominates((60,), (30, 30)) and not P.dominates((30, 30), (60,))


def test_containers(spark):
    df = spark.createDataFrame([(1, 25, "a"), (2, 10, "a"), (3, 0, "b"), (4, 3, "b"), (4, 3, "b"), (5, 7, "c")], "id long, n_tokens long, cell string")
    rows = P.pack_containers(df.select("id", "n_tokens"), "id", 10, 3).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.id, []).append((r.part, r.first_token, r.n_tokens))
    assert sorted(parts[1]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and sorted(parts[2]) == [(0, 0, 10)]
    assert [r.container_id for r in rows if r.id == 3] == [None] and len(parts[4]) == 2
    used = {}
    for r in rows:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 10
    assert P.pack_containers(df.select("id", "n_tokens").limit(0), "id").count() == 0


def test_p8_assigns_every_token(spark, small):
    df = P.p8_containers(spark, small).cache()
    sizes = P.token_counts(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text", P.tokenizer_path())
    assert df.groupBy("doc_id").agg({"n_tokens": "sum"}).exceptAll(sizes).count() == 0
    assert P.fill_report(df).first().unused_share < 0.05


# --- leakage
def brute(items, text):
    windows = {}
    for i, t in items.items():
        w = K.words(t)
        for k in range(len(w) - 11):
            windows.setdefault(tuple(w[k : k + 12]), set()).add(i)
    w = K.words(text)
    return {i for k in range(len(w) - 11) for i in windows.get(tuple(w[k : k + 12]), ())}


def test_automaton_against_brute_force():
    rng = random.Random(5)
    word = lambda: rng.choice("أب تث جح خد ab cd ef gh".split())
    items = {i: " ".join(word() for _ in range(rng.randint(0, 60))) for i in range(30)}
    automaton = K.SuffixAutomaton(items)
    reader = K.Reader(automaton)
    for _ in range(200):
        source = items[rng.randrange(30)].split()
        cut = rng.randrange(len(source) + 1)
        text = " ".join([word() for _ in range(5)] + source[cut : cut + rng.randint(5, 30)] + [word() for _ in range(5)])
        assert {i for _, _, i in reader.spans(text)} == brute(items, text)


def test_automaton_travels_as_arrays():
    items = {i: " ".join(f"w{(i * k) % 50}" for k in range(40)) for i in range(20)} | {99: "", 98: "short"}
    automaton = K.SuffixAutomaton(items)
    copy = pickle.loads(pickle.dumps(automaton))
    for i in items:
        assert K.Reader(copy).spans(items[i]) == K.Reader(automaton).spans(items[i])
    assert pickle.loads(pickle.dumps(K.SuffixAutomaton({}))).matches([0, -1]) == []


def test_items_beyond_one_automaton(spark):
    item = " ".join(f"كلمة{i}" for i in range(60))
    items = spark.createDataFrame([(7, item), (8, " ".join(f"x{i}" for i in range(14))), (9, None)], "item_id long, item_text string")
    docs = spark.createDataFrame([(k, " ".join(item.split()[k : k + 12])) for k in range(49)] + [(99, " ".join(f"x{i}" for i in range(14)))], "id long, text string")
    automata = K.automata_of(items, "item_id", "item_text", most=20)
    assert len(automata) > 3
    assert {(r.id, r.item_id) for r in K.leaked_items(docs, "id", "text", automata).collect()} == {(k, 7) for k in range(49)} | {(99, 8)}
    assert K.clean_texts(docs, "id", "text", automata).count() == 50
    assert len(K.automata_of(items.limit(0), "item_id", "item_text")) == 1


def test_p9_against_sql(spark, medium):
    assert_same(K.p9_found(spark, medium), duck(medium), K.P9_SQL)


def test_folding():
    assert K.words("إِنَّ الـقـرار رقم (١٢)، ID‏-7") == ["ان", "القرار", "رقم", "12", "id", "7"]


def test_leaks_and_cleaning(spark):
    item = " ".join(f"كلمة{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "قبل " + item + " بعد " + "حشو " * 30, "a"), (1, "قبل " + item + " بعد " + "حشو " * 30, "a"), (2, item, "b"), (3, None, "c"), (4, "", "d"), (5, " ".join(item.split()[:11]), "e")], "id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, item_text string")
    automaton = K.automata_of(items, "item_id", "item_text")
    assert sorted((r.id, r.item_id) for r in K.leaked_items(docs, "id", "text", automaton).collect()) == [(1, 7), (1, 7), (2, 7)]
    cleaned = {r.id: r.text for r in K.clean_texts(docs, "id", "text", automaton).collect()}
    assert cleaned[2] is None and "كلمة0 " not in cleaned[1] and cleaned[1].startswith("قبل ") and "بعد" in cleaned[1]
    assert K.leaked_items(docs.limit(0), "id", "text", automaton).count() == 0


def test_p9_against_brute_force(spark, small):
    items = {r.item_id: r.item_text or "" for r in spark.read.parquet(f"{small}/eval_items.parquet").collect()}
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text for i in brute(items, r.text)}
    assert {(r.doc_id, r.item_id) for r in K.p9_found(spark, small).collect()} == want and want


# --- toxicity
@pytest.fixture(scope="module")
def samples(spark, small):
    return [(r.text, r.label) for r in spark.read.parquet(f"{small}/review_samples.parquet").orderBy("sample_id").collect() if r.text and r.label]


def test_held_out_accuracy(samples):
    rng = random.Random(11)
    rng.shuffle(samples)
    cut = len(samples) * 2 // 3
    scores = X.Classifier(samples[:cut]).score([t for t, _ in samples[cut:]])
    right = [{c for c, p in zip(X.CATEGORIES, row) if p >= X.THRESHOLD} == ({label} - {"none"}) for row, (_, label) in zip(scores, samples[cut:])]
    assert np.mean(right) > 0.95


def test_spellings_and_edges(samples):
    model = X.Classifier(samples)
    texts = ["أنت غبي ولا تستحق أن تجلس هنا", "أنت غ ب ي ولا تستحق أن تجلس هنا", "أنت غببببي ولا تستحق أن تجلس هنا", "You are a st*pid cow", None, "", "!!!", "شركة" * 40_000]
    scores = model.score(texts)
    assert (scores[:4, 0] > X.THRESHOLD).all() and (scores[4:7] == 0).all() and (scores[7] < X.THRESHOLD).all()


def test_factorization_learns_what_lines_cannot():
    data = [([1, 2], 1), ([3, 4], 1), ([1, 4], 0), ([3, 2], 0)] * 20
    machine = X.FactorizationMachine()
    machine.fit([x for x, _ in data], np.array([float(y) for _, y in data]), epochs=150)
    assert [bool(s > 0) for s in machine.scores([[1, 2], [3, 4], [1, 4], [3, 2]])] == [True, True, False, False]


def test_slots_are_learnt_from_reviewed_texts():
    samples = [(f"we say all {g} are bad folk", "hateful") for g in ("Aloni", "Beruni", "Ceroni")] + [(f"the {o} is open today", "none") for o in ("shop", "park", "hall")]
    terms = X.Terms()
    terms.learn_slots(samples + [(f"the {o} is open today", "hateful") for o in ("club", "yard", "mall")])
    assert terms.slots == {"alon": "group", "berun": "group", "ceron": "group"}


def test_scores_match_the_formula(samples):
    model = X.Classifier(samples[:150])
    text = "أنت غبي، ولا تستحق المكان"
    layout = X.Layout()
    layout.add(0, text)
    machine = X.Classifier._learn([(model._spans(t), label) for t, label in samples[:150]], "abusive")
    want = max(machine.scores(model._spans(text)))
    other = X.Classifier(samples[:150], lists=False)
    assert other.score([text]).shape == (1, 3) and np.isfinite(want)
    z = model.machines[0].scores(model._spans(text)).max()
    assert abs(model.score([text])[0, 0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_model_is_trained_once(spark, small, monkeypatch):
    frame = spark.read.parquet(f"{small}/review_samples.parquet")
    first = X.fit_classifier(frame, "text", "label")
    monkeypatch.setattr(X.Classifier, "__init__", None)
    again = X.fit_classifier(frame, "text", "label")
    assert np.array_equal(first.score(["أنت غبي"]), again.score(["أنت غبي"]))


def test_rates(spark, small):
    rates = X.p10_rates(spark, small).collect()
    assert sum(r.n_docs for r in rates) == spark.read.parquet(f"{small}/documents.parquet").count()
