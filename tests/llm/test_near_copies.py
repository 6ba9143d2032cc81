"""Near copies against brute force, and the pipeline's stage on them."""

import random

import pytest

import corpus_pipeline
from epochlane.llm import near_copies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def brute(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, t) in enumerate(rows):
        for e, u in rows[i + 1 :]:
            if jaccard(t, u) >= 0.8:
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def changed(words, n):
    words = list(words)
    for i in random.sample(range(len(words)), n):
        words[i] = f"new{random.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [0, 120])
def test_components_are_those_of_brute_force(spark, crowd):
    random.seed(crowd)
    make = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        words = make(random.choice([40, 200, 400]))
        texts += [" ".join(words), *(changed(words, k) for k in (1, len(words) // 50 + 1, len(words) // 20, len(words) // 8))]
    base = make(300)
    texts += [changed(base, 3) for _ in range(crowd)] + ["one two", "one two", "one two three"]
    rows = list(enumerate(texts, 1))
    random.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_the_stage_joins_near_copies_of_many_bits(spark):
    random.seed(4)
    words = [f"w{random.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(words), changed(words, 5), changed(words, 60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2]


def test_links_of_crowded_cells_that_avoid_the_least_one(spark, monkeypatch):
    """A cell of 200 texts: each is linked with its neighbours in a chain alone, and bags count too."""
    random.seed(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(200):
        texts.append(" ".join(words))
        words = words[6:] + [f"n{i}x{j}" for j in range(6)]
    rows = list(enumerate(texts, 1))
    random.shuffle(rows)
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    monkeypatch.setattr(near_copies, "bands", lambda found: list(range(near_copies.BANDS)))  # all in one cell of each band
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) == 1


def test_bags_count_repetitions():
    import pyarrow as pa

    from epochlane.llm import jaccard as join

    texts = pa.array(["a b a b a b c", "a b c d", "x"], pa.string())
    sets, bags = (list(join._sets(texts, join.Grams(2, b))) for b in (False, True))
    assert [len(x) for x in sets] == [3, 3, 1] and [len(x) for x in bags] == [6, 3, 1]
    assert set(sets[0].tolist()) <= set(bags[0].tolist()) and sets[1].tolist() == bags[1].tolist()


def test_sets_and_bags_are_joined_at_once(spark):
    """Texts that only their sets or only their bags link; a third one hangs on the other's bag."""
    from epochlane.llm import jaccard as join

    many = [f"w{i}" for i in range(20)]
    again = many * 3
    texts = {"a": " ".join(many), "b": " ".join(again), "c": " ".join([*again, "x", "y"]), "d": " ".join(f"v{i}" for i in range(20))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    each = [{r["doc_id"]: r["component_id"] for r in join.components(docs, 2, 80, **how).collect()} for how in ({}, {"bags": True}, {"both": True})]
    assert each == [{"a": "a", "b": "a", "c": "a", "d": "d"}, {"a": "a", "b": "b", "c": "b", "d": "d"}, {"a": "a", "b": "a", "c": "a", "d": "d"}]
    known = spark.createDataFrame([("d", "b")], "src string, dst string")
    assert {r["component_id"] for r in join.components(docs, 2, 80, both=True, known=known).collect()} == {"a"}


def test_a_group_meets_single_texts_once_a_token(spark):
    """Many copies and single texts share tokens: the rows of their pairs grow with the groups, not with the copies."""
    from epochlane.llm import jaccard as join

    rows = [(t, g, n, 100, 0) for t in range(5) for g, nodes in ((0, range(300)), (1000, [1000]), (1001, [1001])) for n in nodes]
    shared = spark.createDataFrame(rows, "token long, grp long, node long, n long, pos int")
    matrix = join.matrix_of(shared)
    assert matrix.count() == 15
    assert sorted(map(tuple, join.qualifying(matrix, 80).collect())) == [(0, 1000), (0, 1001), (1000, 1001)]
