"""Groups of near copies by the Jaccard similarity of word shingles: SimHash and MinHash candidates, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.llm import jaccard, simhash
from epochlane.operators.graph import connected_components
from epochlane.operators.skew import join_spread
from epochlane.llm.workers import tidy
from epochlane.session import discard, materialise

WORDS = 5
LEAST = 0.8
#: Two texts share a band when its ROWS least hashes are equal: of pairs at similarity s, (1 - s ** ROWS) ** BANDS share none, at 0.8 3 in 100,000.
BANDS, ROWS = 20, 4
#: Of so many bands of a fuller cell, rows also meet at random, not only its least one.
MEETING_BANDS = 4
SLICE = 1 << 13

_RANDOM = np.random.RandomState(42)
_XOR, _TIMES = (_RANDOM.randint(0, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) for _ in range(2))
_TIMES = (_TIMES << np.uint64(1)) | np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """Signed 64-bit hashes of the bands of a text's shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        h = (found[at : at + SLICE, None] ^ _XOR) * _TIMES
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), j) - (1 << 63) for j, row in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of the Jaccard similarities of two lists of shingle hashes as sets and as bags; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return max(len(i) / (len(x) + len(y) - len(i)), both / (len(a) + len(b) - both))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, node, fp, bands) of every row: node names the text, equal texts alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, cells = [], []
            for text in batch.column("text"):
                found = simhash.digests(text.as_py(), words)
                fps.append(simhash.majority(found))
                cells.append(bands(found))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "node": batch.column("node"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), "bands": pa.array(cells, pa.list_(pa.int64()))})

    return _with_node(docs).select("doc_id", "node", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, node string, fp long, bands array<long>")


def _with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.md5(F.coalesce("text", F.lit(""))))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst), src < dst, written: pairs of nodes that share a band or have fingerprints within two bits; and the nodes of crowded cells, written.

    nodes: a written table (node, fp, bands), each node once. Cells of up to CELL_MOST nodes give
    all their pairs. In fuller ones every node meets the least one, and in MEETING_BANDS of the
    bands also the few that a hash deals to the same part, so the number of pairs is linear; the other links between
    nodes of such cells are left to an exact join."""
    cells = nodes.select("node", F.posexplode("bands").alias("band", "cell"))
    full = materialise(cells.groupBy("band", "cell").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    crowd = materialise(cells.join(full, ["band", "cell"]))
    few = F.col("n") <= simhash.CELL_MOST
    part = F.when(few, 0).otherwise(F.pmod(F.xxhash64("node", "band"), F.floor(F.col("n") / 2)))
    meet = crowd.where(few | (F.col("band") < MEETING_BANDS)).withColumn("part", part)
    a, b = (meet.select("band", "cell", "part", F.col("node").alias(x)) for x in ("src", "dst"))
    pairs = a.join(b, ["band", "cell", "part"]).where("src < dst").select("src", "dst")
    stars = crowd.where(~few).select(F.col("least").alias("src"), F.col("node").alias("dst"))
    of_fp = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(of_fp, "fp").select(F.col("least").alias("src"), F.col("node").alias("dst"))
    ends = (of_fp.select(F.col("fp").alias(x), F.col("least").alias(f"n_{x}")) for x in ("src", "dst"))
    of_links = materialise(simhash.links(of_fp))
    links = of_links.join(next(ends), "src").join(next(ends), "dst").select(F.least("n_src", "n_dst").alias("src"), F.greatest("n_src", "n_dst").alias("dst"))
    found = materialise(pairs.union(stars).union(same).union(links).where("src < dst").distinct()), materialise(crowd.where(~few).select("node").distinct())
    discard(full, crowd, of_fp, of_links)
    return found


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text), written: the texts of ids (node), each once."""
    return materialise(_with_node(docs).select("node", "text").join(ids.distinct(), "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The pairs (src, dst), written, whose whole texts are similar to at least `least`; texts: (node, text), each node once."""
    ids = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    texts = texts.join(ids, "node", "left_semi")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash.digests(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "h": pa.array(found, pa.binary())})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [similarity(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= least for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(on, pa.bool_()))

    sets = materialise(texts.mapInArrow(tidy(hashes), "node string, h binary"))
    at = pairs.join(sets.select(F.col("node").alias("dst"), F.col("h").alias("b")), "dst")
    both = join_spread(at, sets.select(F.col("node").alias("src"), F.col("h").alias("a")), ["src"], "dst")
    found = materialise(both.select("src", "dst", "a", "b").mapInArrow(tidy(check), "src string, dst string"))
    discard(sets)
    return found


def components(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text; others are ignored).

    component_id: the smallest doc_id reachable over links, itself included. Texts are linked
    when their shingle hashes, as sets or as bags, have a Jaccard similarity of `least` or more;
    every link is checked on the whole texts. Null and empty texts are alike; rows with a null
    doc_id come back with their text's component; repeated rows give repeated results. Texts of crowded cells, where
    not all pairs are candidates, are joined exactly, as sets and as bags at once, so no link between them is lost; the links
    that were found before put them into groups there."""
    of_doc = materialise(signatures(docs, words))
    nodes = materialise(of_doc.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    discard(of_doc)
    pairs, crowded = candidates(nodes.drop("least"))
    texts = texts_of(docs, pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(crowded))
    found = verified(pairs, texts, words, least)
    discard(pairs)
    if not crowded.isEmpty():
        many = materialise(texts.join(crowded, "node", "left_semi").select(F.col("node").alias("doc_id"), "text"))
        discard(texts)
        exact = jaccard.components(many, words, round(100 * least), both=True, known=found)
        found = materialise(found.union(exact.where("doc_id <> component_id").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))))
    comps = connected_components(found)
    named = materialise(nodes.select("node", "least").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = materialise(named.join(ids, "component").select("node", "component_id"))
    return _with_node(docs).select("doc_id", "node").join(of_node, "node").select("doc_id", "component_id")
