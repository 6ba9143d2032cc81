"""The operators against brute-force versions on a small table of hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epochlane.llm import bpe, cuckoo, exact_dedup, langid, line_dedup, mixing, queries, seeds, sharding, simhash, suffix_dedup, topk, url_filter
from epochlane.session import materialise

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- 1


def test_urls(spark):
    html = '<html><head><LINK href="{0}" rel="canonical"></head>'
    redirect = '<meta http-equiv="refresh" content="0; url={0}">'
    rows = [
        (1, "http://a.Example.ORG/es/x?utm_source=1#f", None), (2, "https://other.net/copy", html.format("http://example.org/es/x")), (3, "http://deep.net/r", redirect.format("https://other.net/copy/")),
        (4, "http://fine.com/fr/page", html.format("http://bad.com/de/x")), (5, "http://bad.com/de/x", ""), (6, "http://alias.net/z", html.format("//fine.com/fr/page")),
        (7, None, None), (8, "no scheme", "x"), (9, "http://example.org", None), (10, "http://x.de/", None), (11, "http://EXAMPLE.org/en/12", None), (12, "http://lonely.net/", html.format("/self")), (13, "ftp://u://v/w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert len(got) == 13
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == (None, "block")
    assert got[3]["verdict"] == "block"
    assert got[4]["verdict"] == "allow" and got[5]["verdict"] == "block"
    assert got[6]["verdict"] == "allow"  # its group has an explicit allow
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (7, 8)] == [("", "", None, "allow")] * 2
    assert got[9]["rule"] is None and got[9]["path"] == ""
    assert got[11]["rule"] == "example.org/en/1" and got[12]["verdict"] == "allow"
    assert (got[13]["host"], got[13]["path"]) == ("u:", "//v/w")
    assert url_filter.judge(pages.where("false"), queries.URL_RULES).count() == 0


def test_many_rules_give_the_same_as_few(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.d{i % 3}.net/p{i % 4}/q", "") for i in range(60)], "page_id long, url string, html string")
    rules = [(f"h{i}.d{j}.net/p{k}", "block") for i in range(5) for j in range(2) for k in range(2)] + [("net/", "allow"), ("d1.net/p1/q", "allow")]
    few = url_filter.with_rule(pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")), rules)
    many = url_filter._with_rule_joined(few.select("page_id", "host", "path"), rules)
    key = lambda df: sorted((r["page_id"], r["rule"], r["rule_verdict"]) for r in df.collect())
    assert key(few) == key(many)


# --- 2


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation(), t.no_padding()
    return t


def check_bpe(rows, tokenizer):
    for text, r in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert list(r["ids"]) == ids


def test_bpe(spark, docs, tokenizer):
    extra = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "I'll we've  don't\u00a0\u2003x", "日本語 テキスト ½ ² ٣", "a" * 3000, "\n\n \t  x \r\n", "\x1c \x1d\u2028\u0085", "😀👩‍👩‍👧", "ﬁ ǅ ᾈ"]
    random.seed(5)
    extra += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(160, 0x2FFF), random.randrange(0x3000, 0xD7FF), random.randrange(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(20)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = bpe.encode_decode(df, queries.vocabulary_path(), with_ids=True).collect()
    by = defaultdict(list)
    for d, t in texts(df):
        by[d].append(t)
    assert len(got) == df.count()
    check_bpe([(by[r["doc_id"]][0], r) for r in got], tokenizer)


def test_pieces_cut_every_character_alike(tokenizer):
    """White space, letters and numbers are what the tokenizer takes for them."""
    codec = bpe.Codec(bpe.Vocabulary.parse(open(queries.vocabulary_path(), encoding="utf-8").read()), bpe.odd_characters())
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 5 * 512):
        text = "".join(f"a{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}" for c in every[at : at + 512])
        assert codec.split(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_segment_tree_merges_lowest_leftmost():
    merges = {bpe.pair_key(a, b): bpe.merge_value(rank, to) for a, b, rank, to in ((1, 1, 0, 2), (2, 1, 1, 3), (2, 2, 2, 4))}
    assert bpe.merge_piece([1] * 5, merges) == [2, 3]
    assert bpe.merge_piece([1] * 4, merges) == [4]
    assert bpe.merge_piece([9], merges) == [9] and bpe.merge_piece([], merges) == []


# --- 3


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    want = {d: brute_fingerprint(t) for d, t in texts(docs)}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["fp"] % (1 << 64) == want[r["doc_id"]]
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == 4
    least = defaultdict(list)
    roots = brute_components(sorted(set(want.values())))
    for d, f in want.items():
        least[roots[f]].append(d if d is not None else 10**9)
    assert all(comp[d] == min(least[roots[f]]) for d, f in want.items() if d is not None)
    assert simhash.near_duplicates(empty).count() == 0


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("crowd", [0, 60])
def test_links_of_sparse_and_crowded_fingerprints(spark, crowd, monkeypatch):
    from epochlane.operators.graph import connected_components

    random.seed(crowd)
    fps = [random.getrandbits(64) for _ in range(60)]
    fps += [f ^ 1 << random.randrange(64) ^ 1 << random.randrange(64) for f in fps] + [f ^ 7 << random.randrange(61) for f in fps]
    base = random.getrandbits(64)
    for _ in range(crowd):  # a chain in few cells: more than one cell may pair
        base ^= 1 << random.randrange(4) ^ 1 << random.randrange(4)
        fps.append(base ^ random.getrandbits(10))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = materialise(spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, least long"))
    got = {r["node"]: r["component"] for r in connected_components(materialise(simhash.links(table))).collect()}
    want = brute_components(fps)
    groups = defaultdict(set)
    for f, s in zip(fps, signed, strict=True):
        groups[want[f]].add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_manhattan_distance_never_exceeds_hamming(spark):
    random.seed(1)
    pairs = [(random.getrandbits(63), random.getrandbits(63)) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b")))).alias("m")).collect()
    for r in got:
        counts = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
        assert r["m"] == sum(abs(p - q) for p, q in zip(counts(r["a"]), counts(r["b"]), strict=True)) <= (r["a"] ^ r["b"]).bit_count()


# --- 4


def test_language(spark, docs, empty):
    random.seed(2)
    words = {"xx": ["kala", "mina", "suomi", "talo", "vesi"], "yy": ["chth", "wrxt", "bzzt", "grrp", "qurk"]}
    make = lambda k: " ".join(random.choice(words[k]) for _ in range(30))
    known = spark.createDataFrame([(i, make("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    model = langid.fit(known)
    assert model.langs == sorted(model.langs) and set(model.langs) == {"xx", "yy"} and 2 <= len(model.langs) <= 2 * langid.CENTROIDS
    got = langid.predict(known, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(r["lang_pred"] == r["lang"] and not r["rejected"] and 0 <= r["score"] <= 1 for r in held)
    odd = {r["doc_id"]: r for r in langid.predict(docs.where("doc_id is not null"), model).collect()}
    assert all(odd[d]["lang_pred"] == "und" and odd[d]["score"] == 0 and odd[d]["rejected"] for d in (1, 2, 3, 10))
    assert all(r["lang_pred"] in ("xx", "yy") for d, r in odd.items() if d not in (1, 2, 3, 10))
    assert langid.accepted(docs, model).columns == docs.columns
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.Model()).collect()} == {"und"}


def test_language_counts_whole_texts(monkeypatch):
    random.seed(3)
    text = "".join(random.choice("abc déf  .,ß\n") for _ in range(5000))
    want, n = langid.count_ngrams(text)
    monkeypatch.setattr(langid, "SLICE", 97)
    got, m = langid.count_ngrams(text)
    assert (want == got).all() and n == m


def test_held_out_accuracy(spark):
    found = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98


# --- 5


def test_schedule_stays_within_one_block(spark):
    for quota in ([1], [3, 1], [5, 4, 3, 2, 1], [7, 7, 7], [1, 10, 1]):
        order = spark.range(1).select(mixing.edf(F.array(*[F.lit(q).cast("long") for q in quota])).alias("o")).first()["o"]
        assert Counter(order) == Counter({i: q for i, q in enumerate(quota)})
        h = sum(quota)
        for t in range(1, h + 1):
            for i, q in enumerate(quota):
                assert abs(order[:t].count(i) - t * q / h) < 1


def test_mixing(spark, docs, empty):
    sizes = {"a": 700, "b": 40, "c": 333, "zz": 90}
    rows = [(1000 * i + j, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash"))
    got = mixing.mix(df, {"a": 5, "b": 2, "c": 1}, 10).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    blocks = [s for _, s in sorted({(r["slot"], r["mix_source"]) for r in got})]
    weight, left = {"a": 5, "b": 2, "c": 1, "(other)": 1}, Counter(blocks)
    done = Counter()
    for t, s in enumerate(blocks[: 9 * 2], 1):  # all sources still have blocks
        done[s] += 1
        assert all(abs(done[k] - t * w / 9) < 1 for k, w in weight.items())
    assert sum(left.values()) == len(blocks) == 70 + 4 + 34 + 10
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0
    assert mixing.in_mixed_order(docs).count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


# --- 6


def test_exact(docs, empty):
    rows = texts(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    got = exact_dedup.duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {d: norm(t) for d, t in rows}
    for r in got:
        g = groups[by_id[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"]) == (min(g)[3], len(g))
        assert r["kept"] == (r["doc_id"] == r["keep_id"]) and r["text_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()
    assert exact_dedup.duplicates(docs, runs=1).count() == len(rows) and exact_dedup.duplicates(empty).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_of_rows_that_repeat_an_id_the_longest_stays(spark):
    rows = [(1, "ab"), (1, "a  b     "), (1, " a  b    "), (2, "ab"), (None, "x y"), (None, "xy"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in exact_dedup.keep_one(df).collect()) == Counter([(1, " a  b    "), (None, "x y"), (3, "")])
    got = exact_dedup.duplicates(df.repartition(5), runs=6, ways=4).where("doc_id = 2").first()
    assert (got["keep_id"], got["group_size"], got["kept"], got["keep_points"]) == (1, 4, False, 9)


# --- 7


def brute_repeats(rows, length=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((d, len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), np.frombuffer(x, np.uint8)[~gone].tobytes()))
    return Counter(out)


def test_repeated_strings(spark, docs, empty):
    random.seed(4)
    word = lambda n: "".join(random.choice("abcdefgh äß\n") for _ in range(n))
    shared, edge = word(700), word(201)
    more = [word(300) + shared + word(50), shared[100:] + word(400), word(10) + shared[:199], edge + word(90), word(90) + edge[:200] + "!", word(90) + edge[1:], "ab" * 400, "xyzzy" * 41 + word(30), word(250), "\x00" * 260]
    short = docs.where("doc_id is null or doc_id not in (8, 9)").select("doc_id", "text", "salt")
    df = short.union(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(more)], "doc_id long, text string, salt int"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == brute_repeats(texts(df))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("per_task", [300, 400_000])
def test_repeats_of_periods_and_edges_over_many_tasks(spark, monkeypatch, per_task):
    monkeypatch.setattr(suffix_dedup, "ROWS_PER_TASK", per_task)
    random.seed(6)
    word = lambda n: "".join(random.choice("abcde fg\n") for _ in range(n))
    shared, period = word(900), word(30)
    # long periods in one text and in two, near copies, and a part of a period
    rows = [word(70) + "z" * 1500 + word(40), "z" * 700, period * 20 + word(20), word(33) + period * 15, shared, shared[:400] + "Q" + shared[401:], word(9) + shared[150:820] + word(9), word(400), ("ab" * 300) + word(60)]
    rows += [shared[:300] + word(5) + shared[300:], None, "", shared[10:205], shared[10:210]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == brute_repeats(texts(df))


def test_blocks_that_span_tasks_keep_one_name(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ROWS_PER_TASK", 50)
    random.seed(6)
    rows = [(i, random.choice([5, 5, 5, 5, 7, 9]), 0) for i in range(600)]
    got = suffix_dedup.name(materialise(spark.createDataFrame(rows, "pos long, a long, b long")), ["a", "b"], 600).collect()
    names = defaultdict(set)
    for r in got:
        names[rows[r["pos"]][1]].add(r["name"])
    assert all(len(n) == 1 for n in names.values())
    assert max(names[5]) < min(names[7]) and max(names[7]) < min(names[9])


def test_window_minima_agree_for_equal_strings():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 900).astype(np.uint8)
    y = np.concatenate((rng.integers(0, 4, 77).astype(np.uint8), x[300:700]))
    assert (seeds.window_minima(x, 200)[300:501] == seeds.window_minima(y, 200)[77:278]).all()


# --- 8


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 5 or d == max(i for i in held[key(x)] if i is not None)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def clean(docs, index):
    return Counter(tuple(r) for r in line_dedup.clean(docs, index).collect())


def test_lines(docs, empty, monkeypatch):
    index = line_dedup.build(docs)
    assert clean(docs, index) == brute_lines(texts(docs))
    assert sum(n for (_, _, dropped, _), n in clean(docs, index).items() if dropped) == 6
    assert line_dedup.clean(empty, line_dedup.build(empty)).count() == 0
    monkeypatch.setattr(line_dedup, "PAIRS_PER_PART", 2)  # every shard in several parts
    assert clean(docs, index) == brute_lines(texts(docs))


def test_lines_of_null_ids_count_once_and_go(spark, docs):
    held = lambda index: {(bytes(r["key"]), r["n_docs"]) for r in index.refs.collect()}
    null = docs.where("doc_id is null").withColumn("text", F.lit("A line of more than forty letters without an id"))
    index = line_dedup.build(docs)
    once = line_dedup.insert(index, null)
    assert held(line_dedup.insert(once, null)) == held(once) != held(index)
    assert held(line_dedup.delete(once, null)) == held(line_dedup.build(docs.where("doc_id is not null")))


def test_lines_inserted_and_deleted_again(spark, docs):
    first, later = docs.where("doc_id < 23"), docs.where("doc_id >= 23")
    index = line_dedup.insert(line_dedup.build(first), later)
    both = first.union(later)
    assert clean(both, index) == brute_lines(texts(both))
    assert line_dedup.insert(index, later).pairs.count() == index.pairs.count()
    for gone in ([26], [20, 21, 22], list(range(20, 27))):
        ids = spark.createDataFrame([(g,) for g in gone], "doc_id long")
        left = both.join(ids, "doc_id", "left_anti")
        less = line_dedup.delete(index, ids)
        assert clean(left, less) == brute_lines(texts(left))
        assert {(bytes(r["key"]), r["n_docs"]) for r in less.refs.collect()} == {(bytes(r["key"]), r["n_docs"]) for r in line_dedup.build(left).refs.collect()}
    again = line_dedup.insert(line_dedup.delete(index, spark.createDataFrame([(26,)], "doc_id long")), both.where("doc_id = 26"))
    assert clean(both, again) == brute_lines(texts(both))


def test_cuckoo_filter():
    random.seed(7)
    keys = [random.getrandbits(64) for _ in range(3000)]
    f = cuckoo.CuckooFilter.build(np.array(keys, np.uint64))
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(np.array(keys, np.uint64)).all()
    others = np.array([random.getrandbits(64) for _ in range(3000)], np.uint64)
    assert f.contains(others).mean() < 0.01
    assert all(f.delete(k) for k in keys[:1500]) and f.contains(np.array(keys[1500:], np.uint64)).all()
    assert f.contains(np.array(keys[:1500], np.uint64)).mean() < 0.01


# --- 9


@pytest.mark.parametrize("per_shard", [4096, 30])
def test_top_k(spark, per_shard, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", per_shard)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "ROOTS_PER_BUNDLE", 2)
    random.seed(8)
    rows = [(i, [random.choice([0.5, -0.25, random.gauss(0, 1)]) for _ in range(6)], 0) for i in range(200)]
    rows += [(300, None, 0), (301, [1.0, None] * 3, 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (400, [1.0, 2.0], 0), (450, [3.0, 1.0], 0), (500, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q, v in whole.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(v))[:5]
            if best:
                want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_of_repeated_rows_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 10)
    random.seed(9)
    rows = [(i, [1e18, 1.0]) for i in range(0, 30, 10)] + [(i, [-1e18, 2.0]) for i in range(1, 30, 10)] + [(i, [3.0 * (i % 4), 1e12]) for i in range(40, 80)]
    rows += [(100, [1.5, 2.5])] * 7 + [(101 + i, [1.5, 2.5]) for i in range(60)] + [(500, []), (550, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [cut(int(np.floor(256 * x))) for x in v]) for i, v in rows]
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        v = dict(whole)[q]
        best = sorted((-cut(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in whole if i != q and len(w) == len(v))[:5]
        assert got[q] == [(-s, i) for s, i in best], q


def test_cells_hold_neighbours(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 25)
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 30, (12, 4))
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.5, 4)).tolist()) for i in range(600)]
    cells = topk.Cells(np.array([v for _, v in rows]), 12)
    own = cells.of(np.array([v for _, v in rows]))
    assert cells.n == 12 and np.mean([len(set(own[i::12])) for i in range(12)]) < 4  # of 12 cells
    assert set(own) == set(range(12))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    w = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    assert got == [(q, k + 1, i) for q in range(0, 600, 50) for k, (_, i) in enumerate(sorted((-int(w[q] @ w[i]), i) for i in range(600) if i != q)[:3])]


# --- 10


def test_differencing():
    assert [x[0] for x in sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]], 2)].count(0) in (2, 3)
    random.seed(9)
    sizes = [random.randrange(1, 10_000) for _ in range(500)]
    sums = [0] * 16
    for s, to in zip(sizes, sharding.difference([[s, *[0] * 15] for s in sizes], 16), strict=True):
        assert sorted(to) == list(range(16))
        sums[to[0]] += s
    assert max(sums) - min(sums) < 100
    assert sharding.difference([], 4) == []


@pytest.mark.parametrize("bucket, fan", [(2000, 500), (4, 2)])
def test_sharding(spark, docs, empty, bucket, fan, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", bucket)
    monkeypatch.setattr(sharding, "FAN_IN", fan)
    more = spark.createDataFrame([(1000 + i, "t" * (i % 97)) for i in range(300)], "doc_id long, text string")
    df = docs.where("doc_id is null or doc_id not in (8, 9)").select("doc_id", "text").union(more)
    got = sharding.assign(df).collect()
    assert len(got) == df.count()
    by = defaultdict(set)
    for d, t in texts(df):
        by[d].add(t or "")
    shard_of, sums = {}, Counter()
    for r in got:
        text = next(iter(by[r["doc_id"]]))
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
    groups = Counter()
    for d, t in texts(df):
        groups[t or ""] += len((t or "").encode()) + 1
    assert max(sums.values()) - min(sums.values()) <= max(groups.values())
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(empty).count() == 0
