"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of a binary trie. Node pairs are traversed
together from the root: a pair carries the number of bits in which its two
prefixes differ, its children are paired with each other, and a pair whose
differing bits exceed the budget is dropped with all that lies below it. A
level of the traversal is a join of the pairs with the children of either
node; several bits are taken at a level, so a node has at most ``2 ** STEP``
children whatever the number of documents below it.

Equal fingerprints are one leaf, so copies are never paired with one another.
Links join leaves into components by alternating star contractions.

Defined results: a null text or one without words has fingerprint zero and is
linked like any other; ids may be of any type that has an order; rows that
repeat an id are linked through their fingerprints and each keeps its row; null ids never name a component unless
all of its ids are null; a very long text is hashed in pieces; an empty table
gives an empty table; extra columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.words import id_kind
from tilewright.storage import written

SHINGLE = 3
SEED = 42
BUDGET = 2
STEP = 10
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()  # for bytes both keep to ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1]
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(64, np.int64)
    pairs = list(zip(starts.tolist(), ends[shingle - 1 :].tolist()))
    for i in range(0, len(pairs), _CHUNK):
        part = pairs[i : i + _CHUNK]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), np.uint64, len(part))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(pairs))
    return int.from_bytes(bits.tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): ``fp`` is the fingerprint as a signed long."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text")
    ).mapInArrow(_fingerprints, f"doc_id {id_kind(docs, doc_id)}, text_hash long, fp long")


def _prefix_sql(bits: int) -> str:
    return f"shiftrightunsigned(fp, {64 - bits})" if bits < 64 else "fp"


def _prefix(bits: int):
    return F.expr(_prefix_sql(bits))


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(bits), k)]


def links(leaves: DataFrame, n_leaves: int, budget: int = BUDGET) -> DataFrame:
    """(a, b, distance): all pairs of different fingerprints within ``budget`` bits, once each.

    The traversal starts at the depth where a node holds about eight leaves;
    nodes of that depth are paired by flipping up to ``budget`` bits of their
    prefix, which is the traversal of all levels above in one step.
    """
    top = max(4, min(40, n_leaves.bit_length() - 4))
    nodes = leaves.select(_prefix(top).alias("node")).groupBy("node").count()
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(top, budget)))
    pairs = (
        nodes.select(F.col("node").alias("a"), F.col("count").alias("n"), F.explode(masks).alias("mask"))
        .withColumn("b", F.col("a").bitwiseXOR(F.col("mask")))
        .where("a <= b")
        # A node paired with itself needs two leaves below it.
        .where("a < b or n > 1")
        .select("a", "b", F.bit_count("mask").cast("int").alias("dist"))
        .join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    )
    depth = top
    while depth < 64:
        step = min(STEP, 64 - depth)
        low = F.expr(f"{_prefix_sql(depth + step)} & {(1 << step) - 1}L")
        children = leaves.select(_prefix(depth).alias("node"), low.cast("int").alias("c")).groupBy("node").agg(
            F.collect_set("c").alias("cs"), F.count("*").alias("n")
        )
        left = children.select(F.col("node").alias("a"), F.col("cs").alias("ca"), "n")
        right = children.select(F.col("node").alias("b"), F.col("cs").alias("cb"))
        # A node paired with itself goes on only while two leaves lie below it.
        both = pairs.join(left, "a").where("a < b or n > 1").join(right, "b").select("a", "b", "dist", "cb", F.explode("ca").alias("x"))
        near = F.filter(
            "cb",
            lambda y: (F.bit_count(y.bitwiseXOR(F.col("x"))) + F.col("dist") <= budget) & ((F.col("a") < F.col("b")) | (F.col("x") <= y)),
        )
        both = both.select("a", "b", "dist", "x", F.explode(near).alias("y"))
        shifted = lambda p, c: F.shiftleft(p, step).bitwiseOR(F.col(c).cast("long"))
        pairs = both.select(
            shifted("a", "x").alias("a"),
            shifted("b", "y").alias("b"),
            (F.col("dist") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).cast("int").alias("dist"),
        )
        depth += step
    return pairs.where("a <> b").select("a", "b", F.col("dist").alias("distance"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of (a, b): ``root`` is its component's least node.

    Alternating large-star and small-star contractions: each round joins the
    edges with a grouped minimum, so a node of any degree is split by its edges.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, fingerprint, component_id, kept_hash, n_links (of its fingerprint to others).

    ``component_id`` and ``kept_hash`` are the least (id, text hash) of the component, null ids coming last.
    """
    fps = written(fingerprints(docs, doc_id, text), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    leaves = written(fps.groupBy("fp").agg(least.alias("least")), "leaves")
    pairs = written(links(leaves.select("fp"), leaves.count(), budget), "links")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs)
    named = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("kept")).select("root", F.col("kept.doc_id").alias("component_id"), F.col("kept.text_hash").alias("kept_hash"))
    # Written, so that the last join has exchanges of its own and a hot fingerprint's rows can be split.
    by_fp = written(
        named.join(ids, "root").join(degree, "fp", "left").select("fp", "component_id", "kept_hash", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named"
    )
    return fps.join(by_fp, "fp").select(
        "doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept_hash", "n_links"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document for each component, that of its least id and then its least text hash; all columns are kept.

    Rows equal in id and text are one document and stay together. Rows of null
    id go if their component has an id.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))
    drop = near_duplicates(docs).where(~kept).select("doc_id", "text_hash").distinct().alias("b")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("b.text_hash"))
    return d.join(drop, same, "left_anti")
