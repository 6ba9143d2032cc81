"""SimHash near duplicates: popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlane.operators.graph import connected_components
from epochlane.operators.skew import join_spread
from epochlane.llm.workers import tidy
from epochlane.session import materialise

SEED = 42
MOST_BITS = 2
#: Fingerprints of a grid cell that are still paired; fuller cells take the exact star join.
CELL_MOST = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def digests(text: str | None, words_per_shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit hashes of a text's word shingles in their order, repeats included.

    bytes.split() cuts at exactly space and \\t to \\r, and lower-casing bytes A-Z leaves
    other letters alone. Fewer words than a shingle: the whole sequence; none: no hash."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(words_per_shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(found: np.ndarray) -> int:
    """The unsigned number whose bits are those that more than half of the hashes have set."""
    bytes_ = found.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(bytes_[:, j], minlength=256) @ BITS for j in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(found)).tolist()))


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; without words zero."""
    return majority(digests(text, words_per_shingle))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments of fp, each count k as k ones in its segment.

    In this unary form the Manhattan distance of two count vectors is the number of
    differing bits. It never exceeds the fingerprints' own distance."""
    odd = F.lit(0x5555555555555555)
    a, b = F.shiftrightunsigned(fp, 1).bitwiseAND(odd), fp.bitwiseAND(odd)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseOR(b))


def grid_masks(most_bits: int = MOST_BITS, groups: int | None = None) -> list[int]:
    """Masks of the grids over the embedded segments: linked vectors share a cell of one grid at least.

    Of `groups` groups of segments, at most most_bits have a distance above 0 between linked
    vectors, so the others are equal: one grid for each choice of groups - most_bits of them."""
    n = groups or most_bits + 2
    edges = [2 * round(32 * i / n) for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    both = [sum(chosen) for chosen in combinations(masks, n - most_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in both]


def fine_enough(n: int, most_bits: int = MOST_BITS) -> int:
    """The number of groups that leaves about one of n random fingerprints, or fewer, in a cell: a
    segment of two bits tells 1.5 bits apart. More fingerprints take more grids, of smaller cells."""
    groups = most_bits + 2
    while 1.5 * 32 * (groups - most_bits) / groups < math.log2(max(2, n)) and groups < 16:
        groups += 1
    return groups


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): edges over distinct fingerprints whose components are those of the relation
    "differs in MOST_BITS or fewer bits".

    fps: a written table with column fp, each value once. Cells of up to CELL_MOST fingerprints
    give their pairs, filtered by Manhattan distance and then exactly. The fingerprints of fuller
    cells are joined through midpoints instead: two values are within two bits exactly when some
    value is within one bit of both, so each sends itself to its 65 such midpoints and every
    midpoint links its senders to their least. That is linear, and exact with no cap."""
    cells = fps.select("fp", embed(F.col("fp")).alias("e")).select(
        "fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in grid_masks(groups=fine_enough(fps.count()))])).alias("grid", "cell"))
    full = materialise(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    crowd = materialise(join_spread(cells, full.select("grid", "cell", "n"), ["grid", "cell"], "fp").select("fp", "e", "grid", "cell", "n"))
    few = crowd.where(F.col("n") <= CELL_MOST)
    a, b = (few.select("grid", "cell", F.col("fp").alias(x), F.col("e").alias(f"e_{x}")) for x in ("src", "dst"))
    near = (F.bit_count(F.col("e_src").bitwiseXOR(F.col("e_dst"))) <= MOST_BITS) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MOST_BITS)
    pairs = a.join(b, ["grid", "cell"]).where(F.col("src") < F.col("dst")).where(near).select("src", "dst").distinct()
    many = crowd.where(F.col("n") > CELL_MOST).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    mids = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = mids.groupBy("mid").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    stars = mids.join(least, "mid").where("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text; others are ignored).

    component_id: the smallest doc_id reachable over links of two or fewer bits, itself
    included. Null and empty texts have fingerprint zero and link like any other; repeated
    rows give repeated results; an empty table gives an empty table. Rows with a null
    doc_id come back with their fingerprint's component. Equal fingerprints meet first, so
    a group of copies counts as one from there on."""
    of_doc = materialise(fingerprints(docs, words_per_shingle))
    groups = materialise(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(materialise(links(groups)))
    named = groups.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = materialise(join_spread(named.select("fp", "component"), materialise(ids), ["component"], "fp").select("fp", "component_id"))
    return join_spread(of_doc, of_fp, ["fp"], "doc_id").select("doc_id", "fp", "component_id")
