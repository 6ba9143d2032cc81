"""URL aliases and nearest centroids against brute force on whole tables."""

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from urllib.parse import urljoin, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlane.llm import langid, queries, url_filter

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    return host.translate(LOW), path


def form(url):
    host, path = cut(url)
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url or "")
    kept = "&".join(p for p in (query[1].split("&") if query else []) if p and not p.startswith("utm_"))
    return host + re.sub("/+$", "", path) + ("?" + kept if kept else "") if host else None


def best_rule(host, path, rules):
    fits = [(len(r), r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else None


def attributes(tag):
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in re.finditer(r"""(?s)([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)}


def targets(url, page):
    for tag in re.findall(r"(?is)<(?:link|meta)\b[^>]*>", page or ""):
        a, to = attributes(tag), None
        if tag[1:5].lower() == "link" and "canonical" in a.get("rel", "").lower().split():
            to = a.get("href", "").strip()
        elif tag[1:5].lower() == "meta" and a.get("http-equiv", "").lower() == "refresh" and (m := re.match(r"""(?is)[\s\d.]*[;,]?\s*url\s*=\s*["']?([^"']*)""", a.get("content", ""))):
            to = m[1].strip()
        if to and not to.startswith("#") and (full := urljoin(url or "", to)).partition("://")[1]:
            yield full


def brute(rows, rules):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for _, url, page in rows:
        for to in targets(url, page):
            if form(url) and form(to):
                group[root(form(url))] = root(form(to))
    said = defaultdict(set)
    own = {}
    for i, url, _ in rows:
        own[i] = best_rule(*cut(url), rules)
        if own[i] and form(url):
            said[root(form(url))].add(own[i][1])
    for node in list(group):
        if found := best_rule(*cut("://" + node), rules):
            said[root(node)].add(found[1])
    verdict = lambda i, url: own[i][1] if own[i] else "block" if said.get(root(form(url)) if form(url) else None) == {"block"} else "allow"
    return {i: (*cut(url), own[i] and own[i][0], verdict(i, url)) for i, url, _ in rows}


def judged(pages):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, queries.URL_RULES).collect()}


LINKS = [
    '<link rel="alternate canonical" href="page2.html">', "<link href='../de/x' rel='canonical'>", "<link rel=canonical href=?p=1>", '<LINK REL="Canonical" data-href="/no" HREF="/de/./a/../b?x=1&amp;y=2">', '<meta http-equiv="Refresh" content="5; URL=\'../../de/end\'">',
    '<link rel="noncanonical" href="http://bad.com/de/x">', '<link rel="canonical" href="#top">', '<link rel="canonical" href="">', '<link rel="canonical" href="mailto:a@bad.com">', '<link rel="canonical" href="//bad.com/de/x">', '<meta http-equiv=refresh content="0;url=http://bad.com/de/x/">',
]


def test_aliases_by_every_kind_of_link(spark):
    rows = [(i, f"https://site{i}.net/a/b/c{i}.html?k={i}", link) for i, link in enumerate(LINKS)]
    rows += [(50, "https://site0.net/a/b/page2.html", '<link rel="canonical" href="http://bad.com/de/x">'), (51, "http://bad.com/de/x", None), (52, "https://site1.net/a/de/x", '<link rel="canonical" href="http://bad.com/de/y">'), (53, "http://bad.com/de/y", "")]
    rows += [(54, "https://site2.net/a/b/c2.html?p=1", '<link rel="canonical" href="http://bad.com/de/z">'), (55, "https://site3.net/de/b?x=1&y=2", '<link rel="canonical" href="http://bad.com/de/z">'), (56, "https://site4.net/de/end", '<link rel="canonical" href="http://bad.com/de/z">')]
    rows += [(60, "http://tie.net/" + "long/" * 5000, '<link rel="canonical" href="http://bad.com/de/z">' * 50), (61, "http://tie.net/", None), (62, "http://tie.net/", None), (63, "", ""), (64, None, LINKS[-1])]
    got = judged(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = brute(rows, queries.URL_RULES)
    assert got == want
    assert {i for i, w in want.items() if w[3] == "block"} == {0, 1, 2, 3, 4, 9, 10, *range(50, 57), 60}
    again = spark.createDataFrame(rows + rows, "page_id long, url string, html string")
    assert url_filter.judge(again, queries.URL_RULES).count() == 2 * len(rows) and judged(again) == want


def test_aliases_of_the_whole_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    assert judged(pages) == brute([tuple(r) for r in pages.collect()], queries.URL_RULES)


@pytest.mark.parametrize("form_of_rules", [256, 0])
def test_of_equal_rules_allow_wins(spark, form_of_rules, monkeypatch):
    monkeypatch.setattr(url_filter, "INLINE_RULES", form_of_rules)
    page = spark.createDataFrame([("x.net", "/a")], "host string, path string")
    for rules in ([("net/", "block"), ("net/", "allow")], [("net/", "allow"), ("net/", "block")]):
        assert url_filter.with_rule(page, rules).first()["rule_verdict"] == "allow"


# --- language


def plain_vector(text, idf):
    """TF-IDF of letter bigrams and trigrams, class by class, without numpy."""
    chars, bins = [32], Counter()
    for c in text.lower():
        c = ord(c) if c.isalpha() else 32
        if c != 32 or chars[-1] != 32:
            chars.append(c)
    if chars[-1] != 32:
        chars.append(32)
    full = (1 << 64) - 1
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & full for a, b in zip(chars, chars[1:], strict=False)]
    for t in two:
        bins[(t >> 13) % langid.BINS] += 1
    for t, c in zip(two, chars[2:], strict=False):
        bins[((t * 0x27D4EB2F + c * 0x165667B1) & full) >> 17 & (langid.BINS - 1)] += 1
    v = {k: math.log1p(n) * float(idf[k]) for k, n in bins.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1
    return {k: x / norm for k, x in v.items()}


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_the_nearest_centroid_is_found_for_every_text(spark, model):
    assert len(model.langs) == len(model.centroids) and len(set(model.langs)) * langid.CENTROIDS >= len(model.langs) > len(set(model.langs))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        out = got[r["doc_id"]]
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (out["lang_pred"], out["score"], out["rejected"]) == ("und", 0, True)
            continue
        v = plain_vector(r["text"], model.idf)
        cos = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        assert abs(max(cos) - out["score"]) < 1e-4
        assert max(c for c, name in zip(cos, model.langs, strict=True) if name == out["lang_pred"]) > max(cos) - 1e-4
        letters = sum(c.isalpha() for c in r["text"])
        floor = float(model.floors[sum(letters >= x for x in langid.LENGTHS)])
        assert out["rejected"] == (out["score"] < floor) or abs(out["score"] - floor) < 1e-4


def test_document_frequencies_cover_all_rows(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(~langid.held_out("doc_id")).where("lang is not null")
    df, n = Counter(), 0
    for r in docs.collect():
        if any(c.isalpha() for c in r["text"] or ""):
            n += 1
            df.update(plain_vector(r["text"], np.ones(langid.BINS)).keys())
    assert np.allclose(model.idf, [math.log((1 + n) / (1 + df[k])) + 0.1 for k in range(langid.BINS)], atol=1e-4)


def test_far_texts_of_any_length_go_and_near_ones_stay(spark, model):
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 9)))
    far = [" ".join(word(a) for _ in range(n)) for a in ("абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπ", "qxzjkvwyhgbpdfm") for n in (40, 400, 4000)]
    near = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where(langid.held_out("doc_id")).where(F.length("text") > 20).select("text").collect()]
    assert langid.judge(model, far)[2].all()
    assert langid.judge(model, near)[2].mean() < 0.02


def test_starts_leave_outliers_without_a_centroid(spark):
    at = [np.array([10, 11, 12 + i % 5]) for i in range(100)] + [np.array([20, 21, 22 + i % 5]) for i in range(100)] + [np.array([5000 + i]) for i in range(3)]
    mid, cos = langid.cluster(langid.Rows(at, [np.ones(len(a), np.int64) for a in at], np.ones(langid.BINS, np.float32)), 2)
    assert len(mid) == 2 and cos.shape == (203,)
    assert {int(m[[10, 20]].argmax()) for m in mid} == {0, 1}
    same = langid.cluster(langid.Rows([np.array([3])] * 5, [np.array([2])] * 5, np.ones(langid.BINS, np.float32)), 4)
    assert len(same[0]) == 1 and np.allclose(same[1], 1)
