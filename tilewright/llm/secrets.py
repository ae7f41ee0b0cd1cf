"""Secret scans that link the parts of a credential.

Strong patterns report by themselves. Weak candidates (endpoints, bare key
material, user names) say little alone: one is reported only when a
complementary part lies in the same scope, an interval of ``SCOPE`` code
points on either side. The link is an interval join over buckets of that
width: parts are keyed by (document, bucket), and each bucket keeps only the
first and last part of each kind, so that no group of parts is ever paired
with itself. A reported candidate names the part that completes it: of those
first and last ones in scope the nearest, then the first.

Defined results: a null or empty text has no spans; a repeated ``doc_id``
keeps one row for each input row; equal spans of different kinds are all
reported in the order of ``KINDS``; a very long text, or one with very many
matches, takes time in proportion to its length and its matches; an empty table
gives an empty table; extra columns are ignored (``redact`` keeps them). Built
from DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tensor import let
from tilewright.llm.arrays import blocks, cut, prefixes
from tilewright.storage import written

SCOPE = 400

#: The base patterns, with the least length of the named group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak candidates: places to sign in to, bare 40-character keys, user names.
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis)://[A-Za-z0-9._:@/%?&=+-]{4,}"
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
USER = r"(?i)(?<![a-z0-9_])(?:user|user_?name|login|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "endpoint", "bare", "user")
#: A weak kind and the parts that complete it.
COMPLEMENTS = {"endpoint": ("assign", "access", "bare"), "bare": ("access",), "user": ("assign",)}

_SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _matches(text: Column, pattern: str, kind: str, hint: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans in code points; ``hint`` is a cheap test that must hold.

    Pieces between matches and the matches themselves alternate, so that a
    running sum of their lengths gives every offset.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(found)),
        found,
        lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("long"), (keep(m) if keep else F.lit(True)).alias("keep")),
    )
    rank = KINDS.index(kind)

    def span(m: Column, before: Column) -> Column:
        start = before + m["gap"]
        return F.struct(start.alias("start"), (start + m["long"]).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["keep"].alias("keep"))

    placed = let(step, lambda ms: F.zip_with(ms, prefixes(F.transform(ms, lambda m: m["gap"] + m["long"])), span))
    kept = F.filter(placed, lambda x: x["keep"])
    all_spans = F.transform(kept, lambda x: F.struct(x["start"], x["end"], x["rank"], x["kind"]))
    return F.when(F.regexp_like(text, F.lit(hint)), all_spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def part_columns(text: Column) -> dict[str, Column]:
    """Spans of each kind."""
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    return {
        "assign": _matches(text, ASSIGN, "assign", r"(?i)password|passwd|secret|token|api_?key", value),
        "access": _matches(text, ACCESS, "access", ACCESS),
        "hex": _matches(text, HEX, "hex", HEX),
        "endpoint": _matches(text, ENDPOINT, "endpoint", "://"),
        "bare": _matches(text, BARE, "bare", r"[A-Za-z0-9+/]{40}"),
        "user": _matches(text, USER, "user", r"(?i)user|login|client_?id"),
    }


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, one array of spans for each kind): all candidates, weak ones too."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        *(c.alias(k) for k, c in part_columns(body).items()),
    )


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, weak): the weak spans that have a complementary part in scope, each with that part (``with``)."""
    kinds = sorted({k for ks in COMPLEMENTS.values() for k in ks})
    some = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in COMPLEMENTS)) & reduce(lambda a, b: a | b, (F.size(k) > 0 for k in kinds))
    rows = found.where(some).select(
        "doc_id", "text_hash", F.explode(F.concat(*KINDS)).alias("p")
    ).select("doc_id", "text_hash", "p", F.floor(F.col("p.start") / scope).cast("int").alias("bucket"))
    # The complementary parts of a bucket: for each kind its first and its last part.
    edges = rows.where(F.col("p.kind").isin(kinds)).groupBy("doc_id", "text_hash", "bucket").agg(
        *(F.min(F.when(F.col("p.kind") == k, F.col("p"))).alias(f"{k}_lo") for k in kinds),
        *(F.max(F.when(F.col("p.kind") == k, F.col("p"))).alias(f"{k}_hi") for k in kinds),
    )
    seen = edges.select(
        "doc_id", "text_hash",
        F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1)))).alias("bucket"),
        *(c for k in kinds for c in (f"{k}_lo", f"{k}_hi")),
    ).alias("e")
    weak = rows.where(F.col("p.kind").isin(*COMPLEMENTS)).distinct().alias("w")
    same = (
        F.col("w.doc_id").eqNullSafe(F.col("e.doc_id"))
        & (F.col("w.text_hash") == F.col("e.text_hash"))
        & (F.col("w.bucket") == F.col("e.bucket"))
    )
    # Of each kind that completes the candidate's own both edges, nearest first.
    completes = reduce(lambda a, b: a | b, ((F.col("p.kind") == w) & F.col("e.kind").isin(*ks) for w, ks in COMPLEMENTS.items()))
    each = weak.join(seen, same).select("w.doc_id", "w.text_hash", "p", F.explode(F.array(*(f"{k}_{side}" for k in kinds for side in ("lo", "hi")))).alias("e"))
    gap = F.abs(F.col("e.start") - F.col("p.start"))
    near = each.where(completes & (gap <= scope)).groupBy("doc_id", "text_hash", "p").agg(F.min(F.struct(gap.alias("gap"), F.col("e"))).alias("near"))
    return near.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("p.start", "p.end", "p.rank", "p.kind", F.col("near.e").alias("with"))).alias("weak")
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, text_hash, base and all spans in order, a count of each base kind, and pairs.

    ``pairs`` holds the linked weak spans in order, each with the part that completes it.
    """
    found = written(parts(docs, doc_id, text), "parts")
    linked = link(found, scope).alias("l")
    f = found.alias("f")
    same = F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("f.text_hash") == F.col("l.text_hash"))
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    base = F.concat("assign", "access", "hex")
    return f.join(linked, same, "left").select(
        "f.doc_id",
        "f.text_hash",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        order(base).alias("base"),
        order(F.concat(base, F.coalesce(F.transform("weak", lambda w: F.struct(w["start"], w["end"], w["rank"], w["kind"])), F.expr(f"cast(array() as {_SPANS})")))).alias("spans"),
        F.coalesce(F.array_sort("weak"), F.expr("cast(array() as array<struct<start:int,end:int,rank:int,kind:string,with:struct<start:int,end:int,rank:int,kind:string>>>)")).alias("pairs"),
    )


def _named(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, _named), ",")


def paired(pairs: Column) -> Column:
    """``kind:start:end=kind:start:end`` of each weak span and the part that completes it, comma-joined."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", _named(p), _named(p["with"]))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlaps merged, replaced by ``<secret>``; ``spans`` are sorted by start."""

    def done(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])

        def whole(before: Column) -> Column:
            def one(pieces: Column) -> Column:
                gap = lambda x, at: F.when(x["start"] >= at, F.concat(cut(pieces, at, x["start"]), F.lit("<secret>"))).otherwise(F.lit(""))
                return F.concat(F.array_join(F.zip_with(s, before, gap), ""), cut(pieces, F.array_max(ends), F.char_length(text)))

            return let(blocks(text), one)

        return let(prefixes(ends, lambda a, x: F.greatest(a, x)), whole)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, done))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with the same columns: found secrets masked and, where there is one, ``n_chars`` brought up to date."""
    spans = scan(docs, scope=scope).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]).alias("s")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("s.text_hash"))
    clean = F.when(F.col("s.spans").isNull(), F.col("d.text")).otherwise(masked(F.col("d.text"), F.col("s.spans")))
    joined = d.join(spans, same, "left")
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(clean.alias(c))
        elif c == "n_chars":
            kind = dict(docs.dtypes)[c]
            out.append(F.when(F.col("s.spans").isNull(), F.col("d.n_chars")).otherwise(F.char_length(clean).cast(kind)).alias(c))
        else:
            out.append(F.col(f"d.`{c}`").alias(c))
    return joined.select(*out)
