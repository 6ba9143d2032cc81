"""The Jaccard join against all pairs of small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochlane.llm import jaccard, queries, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    to = list(range(len(rows)))

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                to[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def check(df, **more):
    got = jaccard.components(df, **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([(r["doc_id"], r["text"]) for r in df.collect()])


def edited(base, n, rnd, word):
    out = list(base)
    for k in range(n):
        out[rnd.randrange(len(out))] = f"{word}x{k}"
    return " ".join(out)


def test_hashes_are_of_words_not_of_their_places():
    texts = ["a bb ccc " + "d" * 8 + " " + "e" * 9, None, "", "x" * 70 + " bb " + "e" * 9 + "\tA\x0b" + "x" * 64, "é bb", "e" * 9]
    (run,) = words.runs(pa.array(texts, pa.string()), words.NOT_BLANK)
    of = {}
    for h, a, b in zip(jaccard.word_hashes(run).tolist(), run.first, run.end, strict=True):
        assert of.setdefault(run.data[a:b], h) == h
    assert len(set(of.values())) == len(of) and run.words_of_text().tolist() == [5, 0, 0, 5, 2, 1]
    found = list(jaccard._sets(pa.array(texts, pa.string()), jaccard.Grams(4)))
    assert [len(x) for x in found] == [len(plain_set(t)) for t in texts] and all(np.all(np.diff(x.astype(object)) > 0) for x in found if len(x) > 1)


def test_join_of_hard_rows(spark, docs, empty):
    check(docs.where("length(text) < 9000 or text is null"))
    assert jaccard.components(empty).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_join_at_the_edge_of_the_limit(spark, seed):
    """Near copies whose similarity is about the limit, chains of them, common passages, short texts and subsets."""
    rnd, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(6):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.choice([30, 60, 200]))]
        for j in range(12):
            rows.append(edited(base, rnd.randrange(0, max(2, len(base) // 25)), rnd, f"e{g}{j}"))
        for j in range(6):  # a chain: each is linked with its neighbours at most
            base = base[2:] + [f"c{g}{j}a", f"c{g}{j}b"]
            rows.append(" ".join(base))
        rows += [" ".join(base[: len(base) * k // 20]) for k in (17, 18, 19)]
    rows += [" ".join([*passage, *(f"own{i}n{j}" for j in range(rnd.randrange(1, 12)))]) for i in range(40)]
    rows += [" ".join(rnd.choices("abc", k=rnd.randrange(1, 9))) for _ in range(40)]
    rnd.shuffle(rows)
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4).withColumn("grp", F.lit("clash")))


def test_groups_are_opened_where_leaders_are_not_linked(spark, monkeypatch):
    """With one key, few members find their leaders; all other links come from opened groups."""
    monkeypatch.setattr(jaccard, "_keys", lambda found: np.array([int(found[0]) % 3] * jaccard.KEYS, np.uint64))
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(base, rnd.randrange(1, 5), rnd, f"n{i}")) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_join_of_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_jaccard(spark, d).collect()), key=str) == plain(rows)


def test_a_large_group_meets_what_is_nearly_linked_in_cells(spark, monkeypatch):
    """Texts just under the limit from all of a group, and some linked with few of its members, aren't compared pair by pair."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    member = lambda i: " ".join([*base[:-2], f"m{i}", f"m{i}y"])
    rows = [(i, member(i)) for i in range(150)]
    for i in range(150, 190):
        near = base[:]
        near[3 + i % 40] = f"n{i}"
        rows.append((i, " ".join([*near[:-2], f"m{i % 7}" if i % 2 else f"q{i}", f"m{i % 7}y" if i % 4 == 1 else f"r{i}"])))
    rnd.shuffle(rows)
    monkeypatch.setattr(jaccard, "CELL", 1 << 9)
    sent, compared = [], jaccard.compared
    monkeypatch.setattr(jaccard, "compared", lambda pairs, *more: sent.append(pairs.count()) or compared(pairs, *more))
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(sent) < 1000


def test_cells_find_a_link_for_every_node_that_has_one(spark, monkeypatch):
    rnd = np.random.RandomState(3)
    sets = {i: np.unique(rnd.choice(60, 40, False)).astype(np.uint64) for i in range(60)}
    rows = [(i, 1 if i < 40 else i, len(x), x.tobytes()) for i, x in sets.items()]
    table = spark.createDataFrame([(i, g, n, bytearray(h)) for i, g, n, h in rows], "node long, grp long, n long, h binary")
    found = spark.createDataFrame([(i, 1) for i in range(40, 60)], "node long, grp long")
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    want = {i for i in range(40, 60) if any(share(i, j) >= 0.6 for j in range(40))}
    assert want and len(want) < 20
    for cell in (1 << 12, 128):
        monkeypatch.setattr(jaccard, "CELL", cell)
        got = jaccard.met_in_cells(found, table, 60).collect()
        assert {r["src"] for r in got} == want and all(r["dst"] < 40 and share(r["src"], r["dst"]) >= 0.6 for r in got)


def test_shared_tokens_are_of_several_sets(spark):
    """N-grams that only copies of one text have aren't shared; all others that two prefixes have are, by any number of parts."""
    rnd = random.Random(6)
    rows = [" ".join(f"t{i}w{rnd.randrange(999)}" for _ in range(50)) for i in range(30)] * 3
    rows += [edited([f"b{i}" for i in range(40)], 1 + i % 3, rnd, f"e{i}") for i in range(12)] + ["a b", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sig = jaccard.signatures(docs, jaccard.Grams(4), 85).cache()
    of = {r["row"]: r for r in sig.collect()}
    nodes = sig.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("n").alias("n")).withColumn("grp", F.col("node"))
    least = {r["node"] for r in nodes.collect()}
    at = {}
    for row in least:
        for pos, token in enumerate(of[row]["prefix"]):
            at.setdefault(token, []).append((row, pos))
    want = sorted((t, r, r, of[r]["n"], p) for t, found in at.items() if len(found) > 1 for r, p in found)
    assert want and len(least) == 43
    for each in (jaccard.NODES, 4):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard, "NODES", each)
            assert sorted(map(tuple, jaccard.shared_tokens(sig, nodes).collect())) == want


def test_counters_and_cuts_are_sent_in_few_bits():
    rnd = np.random.RandomState(7)
    count, cut = rnd.poisson(0.6, jaccard.WIDTH).astype(np.uint16), np.diff(np.sort(rnd.randint(0, 1 << 32, 9999, np.uint64).astype(np.uint32)), prepend=np.uint32(0))
    count[5] = 65535
    for x, most in ((count, 0.2), (cut, 0.8), (cut[:0], 0)):
        packed = jaccard._packed(x)
        assert np.array_equal(jaccard._unpacked(pa.scalar(packed), len(x), x.dtype.type), x) and len(packed) <= max(32, most * x.nbytes)


def test_the_matrix_is_dealt_once_to_meet_itself(spark):
    rnd = random.Random(8)
    cells = [(t, g, rnd.randrange(1, 30), 20 + g % 9, 22 + g % 9) for t in range(40) for g in rnd.sample(range(30), 4)]
    matrix = jaccard.materialise(spark.createDataFrame(cells, "token long, grp long, left int, low long, high long"))
    got = jaccard.qualifying(matrix, 40)
    need = lambda a, b: -(-40 * (a + b) // 140)
    want = {(g, h) for t, g, x, a, b in cells for s, h, y, c, d in cells if t == s and g < h and 100 * b >= 40 * c and 100 * d >= 40 * a and min(x, y) >= need(a, c)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, found)) == sorted(want)
    assert ["ReusedExchange" in x for x in plan.splitlines() if "Exchange hashpartitioning(token" in x].count(False) == 1
