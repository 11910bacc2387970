"""Duplicate clusters of a query's chunks: edges by level, components, representatives and their novelty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import content_key, terms
from quarry.functions.url import document_key
from quarry.functions.vector import cosine
from quarry.shared import checkpointed

#: Buckets of the table of token counts.
_BUCKETS = 1 << 20

LEVELS = {"document": 1, "chunk": 2, "claim": 3, "semantic": 4}


def _within(chunks: DataFrame, key: Column, level: str) -> DataFrame:
    """Every member of an equal-key group linked to the group's first: a star, not all pairs."""
    w = W.partitionBy("query_id", "key")
    k = chunks.withColumn("key", key).withColumn("a", F.min("chunk_id").over(w))
    return k.filter("a <> chunk_id").select("query_id", "a", F.col("chunk_id").alias("b"), F.lit(LEVELS[level]).alias("level"))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(query_id, node, n, token, m0..m3): the prefix of each set of token hashes, and a 256-bit map of the set.

    The order is that of rising counts of the tokens' buckets, a table of fixed size that every task holds, so no token is
    joined with its count. A token alone in its bucket is in one set only and left out.
    """
    bucket = F.col("token").bitwiseAND(F.lit(_BUCKETS - 1))
    seen = sets.select(F.explode("own").alias("token")).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count")).toArrow()
    counts = np.zeros(_BUCKETS, np.int64)
    counts[seen["bucket"].to_numpy()] = seen["count"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                n = pc.list_value_length(piece.column(2)).to_numpy()
                token, begin = pc.list_flatten(piece.column(2)).to_numpy(), np.cumsum(n) - n
                count, row = counts[token & (_BUCKETS - 1)], np.repeat(np.arange(len(n)), n)
                bit = np.left_shift(np.uint64(1), (token & 63).astype(np.uint64))
                maps = [np.bitwise_or.reduceat(np.where((token >> 6) & 3 == k, bit, np.uint64(0)), begin).view(np.int64) for k in range(4)]
                order = np.lexsort((token, count, row))
                most = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
                order = order[(np.arange(len(row)) - begin[row] < most[row]) & (count[order] > 1)]
                of = row[order]
                columns = [piece.column(0).take(pa.array(of)), piece.column(1).take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(token[order]), *(pa.array(m[of]) for m in maps)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "node", "n", "token", *(f"m{k}" for k in range(4))])

    kind = sets.schema["query_id"].dataType.simpleString()
    return sets.select("query_id", "node", "own").mapInArrow(cut, f"query_id {kind}, node long, n int, token long, {', '.join(f'm{k} long' for k in range(4))}")


def _verified(sets: pa.Table, pairs: pa.Table, threshold: float) -> pa.Table:
    """The pairs (q, a, b) of a cell at or above the threshold, by the sets (node, own) of its nodes."""
    names, first = np.unique(sets["node"].to_numpy(), return_index=True)
    own = sets["own"].combine_chunks().take(pa.array(first))
    n = pc.list_value_length(own).to_numpy()
    word = np.unique(pc.list_flatten(own).to_numpy(), return_inverse=True)[1]
    begin = np.cumsum(n) - n
    order = np.argsort(pairs["a"].to_numpy(), kind="stable")
    a, b = (np.searchsorted(names, pairs[x].to_numpy()[order]) for x in "ab")
    both, here = np.zeros(len(a), np.int64), np.zeros(len(word) and int(word.max()) + 1, bool)
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    for start, end in zip(cuts, [*cuts[1:], len(a)], strict=True):
        mine = word[begin[a[start]] : begin[a[start]] + n[a[start]]]
        here[mine] = True
        for at in range(start, end, 256):
            other = b[at : min(at + 256, end)]
            size = n[other]
            stop = np.cumsum(size)
            both[at : at + len(other)] = np.add.reduceat(here[word[np.arange(stop[-1]) + np.repeat(begin[other] - stop + size, size)]].astype(np.int64), stop - size)
        here[mine] = False
    j = both / (n[a] + n[b] - both)
    keep = j >= threshold
    rows = pa.array(order[keep])
    return pa.table({"query_id": pairs["q"].take(rows), "a": pairs["a"].take(rows), "b": pairs["b"].take(rows), "jaccard": pa.array(j[keep])})


def set_pairs(sets: DataFrame, threshold: float, stars: bool = True, block: int = 1024) -> DataFrame:
    """Pairs (query_id, a, b, jaccard) of token sets (query_id, chunk_id, tokens) at or above a threshold.

    Equal sets are compared once: a set is known by a 64-bit hash of its tokens' hashes. Prefix filter: tokens in order of rising
    frequency; similar sets share one of their first ``n - ceil(t n) + 1``. Sets carry 256-bit maps of their tokens: what is in
    one map only bounds the overlap from above, so few pairs that are not similar meet their sets. Pairs do not carry sets: those
    of near copies have one owner, found by steps from their lesser end to its least neighbour, and a set comes once to each cell of an owner's pairs,
    of which a large owner has one for each two blocks of about ``block`` nodes.
    Two empty sets are similar: with ``stars`` they are linked to the first of them, which is enough for components, else all
    their pairs are given.
    """
    words = F.array_sort(F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)))
    s = checkpointed(sets.select("query_id", "chunk_id", words.alias("own"))).withColumn("n", F.size("own")).withColumn("node", F.xxhash64("own"))
    members = s.filter("n > 0" if stars else "n >= 0").select("query_id", "node", "chunk_id")
    some = s.filter("n > 0").select("query_id", "node", "own")
    prefix = _prefixes(some, threshold).repartition("query_id", "token").dropDuplicates(["query_id", "token", "node"])
    side = lambda c: prefix.select("query_id", "token", F.col("node").alias(c), F.col("n").alias(f"n{c}"), *(F.col(f"m{k}").alias(f"m{k}{c}") for k in range(4)))
    apart = lambda x, y: " + ".join(f"bit_count(m{k}{x} & ~m{k}{y})" for k in range(4))
    most = F.least(F.col("na") - F.expr(apart("a", "b")), F.col("nb") - F.expr(apart("b", "a")))  # of the overlap
    likely = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (most >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6)
    pairs = checkpointed(side("a").join(side("b"), ["query_id", "token"]).filter((F.col("a") < F.col("b")) & likely).select("query_id", "a", "b").distinct())
    least = pairs.groupBy("query_id", F.col("b").alias("a")).agg(F.min("a").alias("least"))
    for _ in range(2):  # of near copies that are not all pairs of each other few owners are left
        least = least.join(least.toDF("query_id", "least", "further"), ["query_id", "least"], "left").select("query_id", "a", F.coalesce("further", "least").alias("least"))
    owned = pairs.join(least, ["query_id", "a"], "left").select("query_id", F.coalesce("least", "a").alias("owner"), "a", "b")
    sizes = owned.groupBy("query_id", "owner").agg(F.ceil((F.approx_count_distinct("b") + 1) / block).cast("int").alias("blocks"))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    cell = ["query_id", "owner", "i", "j"]
    dealt = owned.join(sizes, ["query_id", "owner"]).select("query_id", "owner", place("a").alias("i"), place("b").alias("j"), "a", "b")
    asked = dealt.select(*cell, F.explode(F.array("a", "b")).alias("node")).distinct()
    held = asked.join(some.dropDuplicates(["query_id", "node"]), ["query_id", "node"]).select(*cell, "node", "own")
    kind = sets.schema["query_id"].dataType.simpleString()
    found = held.groupBy(*cell).cogroup(dealt.toDF("q", "o", "k", "l", "a", "b").groupBy("q", "o", "k", "l")).applyInArrow(lambda x, y: _verified(x, y, threshold), f"query_id {kind}, a long, b long, jaccard double")
    left, right = members.toDF("query_id", "a", "one"), members.toDF("query_id", "b", "other")
    ends = [F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")]
    found = found.join(left, ["query_id", "a"]).join(right, ["query_id", "b"]).select("query_id", *ends, "jaccard")
    same = left.join(members.toDF("query_id", "a", "other"), ["query_id", "a"]).filter("one < other").select("query_id", F.col("one").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("jaccard"))
    if not stars:
        return found.unionByName(same)
    empty = s.filter("n = 0").withColumn("a", F.min("chunk_id").over(W.partitionBy("query_id"))).filter("a <> chunk_id")
    return found.unionByName(same).unionByName(empty.select("query_id", "a", F.col("chunk_id").alias("b"), F.lit(1.0).alias("jaccard")))


def edges(chunks: DataFrame, embedding: str | None = None, tau: float = 0.85) -> DataFrame:
    """(query_id, a, b, level): the first level that links two chunks; equal keys as stars.

    The five predicates are joined apart (two equi-joins on keys, two prefix-filtered set joins, one comparison
    of vectors within a query's few chunks), never as one disjunction.
    """
    doc = _within(chunks, document_key(F.col("source"), F.col("url"), F.col("title"), F.col("author"), F.col("publish_date")), "document")
    same = _within(chunks, content_key(F.col("content")), "chunk")
    sets = chunks.select("query_id", "chunk_id", terms(content_key(F.col("content"), 1 << 30)).alias("tokens"))
    near = set_pairs(sets, 0.92).select("query_id", "a", "b", F.lit(LEVELS["chunk"]).alias("level"))
    claims = chunks.select("query_id", "chunk_id", terms(content_key(F.coalesce("claim", F.substring("content", 1, 240)), 1 << 30)).alias("tokens"))
    claim = set_pairs(claims, 0.78).select("query_id", "a", "b", F.lit(LEVELS["claim"]).alias("level"))
    found = doc.unionByName(same).unionByName(near).unionByName(claim)
    if embedding:
        v = chunks.select("query_id", "chunk_id", "source_type", F.col(embedding).alias("v"))
        x, y = v.toDF("query_id", "a", "ka", "va"), v.toDF("query_id", "b", "kb", "vb")
        limit = F.when(F.col("ka") == F.col("kb"), tau).otherwise(max(0.94, tau + 0.08))
        found = found.unionByName(x.join(y, "query_id").filter((F.col("a") < F.col("b")) & (cosine(F.col("va"), F.col("vb")) >= limit)).select("query_id", "a", "b", F.lit(LEVELS["semantic"]).alias("level")))
    return found.groupBy("query_id", "a", "b").agg(F.min("level").alias("level"))


def edges_by_query(chunks: DataFrame, embedding: str | None = None, tau: float = 0.85) -> DataFrame:
    """The same within queries of few chunks (after pre-ranking they are bounded): every pair of a query's chunks in one pass."""
    import numpy as np
    import pandas as pd

    said = F.coalesce("claim", F.substring("content", 1, 240))
    rows = chunks.select(
        "query_id", "chunk_id", "source_type", document_key(F.col("source"), F.col("url"), F.col("title"), F.col("author"), F.col("publish_date")).alias("document"), content_key(F.col("content")).alias("same"),
        F.array_distinct(terms(content_key(F.col("content"), 1 << 30))).alias("near"), F.array_distinct(terms(content_key(said, 1 << 30))).alias("claimed"), (F.col(embedding) if embedding else F.array().cast("array<double>")).alias("v"),
    )

    def link(r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("chunk_id").reset_index(drop=True)
        found: dict[tuple[int, int], int] = {}

        def add(a: int, b: int, level: str) -> None:
            found[a, b] = min(found.get((a, b), 9), LEVELS[level])

        def star(keys: list, level: str) -> None:
            first: dict = {}
            for i, k in enumerate(keys):
                if k is not None and first.setdefault(k, i) != i:
                    add(first[k], i, level)

        star(r.document.tolist(), "document")
        star(r.same.tolist(), "chunk")
        for column, least, level in (("near", 0.92, "chunk"), ("claimed", 0.78, "claim")):
            sets = [frozenset(x) for x in r[column]]
            star([None if x else "" for x in sets], level)
            for i, a in enumerate(sets):
                for j in range(i + 1, len(sets)):
                    b = sets[j]
                    if a and b and min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 and len(a & b) >= least * len(a | b):
                        add(i, j, level)
        if embedding:
            kinds, vectors = r.source_type.tolist(), [np.asarray(x, float) for x in r.v]
            norms = [np.sqrt((x * x).sum()) for x in vectors]
            for i in range(len(r)):
                for j in range(i + 1, len(r)):
                    if len(vectors[i]) == len(vectors[j]) and norms[i] * norms[j] > 0 and float(vectors[i] @ vectors[j]) / (norms[i] * norms[j]) >= (tau if kinds[i] == kinds[j] else max(0.94, tau + 0.08)):
                        add(i, j, "semantic")
        ids, pairs = r.chunk_id.tolist(), sorted(found)
        if not pairs:
            return pd.DataFrame({"query_id": r.query_id[:0], "a": r.chunk_id[:0], "b": r.chunk_id[:0], "level": r.query_id[:0].astype("int32")})
        return pd.DataFrame({"query_id": [r.query_id[0]] * len(pairs), "a": [ids[a] for a, _ in pairs], "b": [ids[b] for _, b in pairs], "level": [found[p] for p in pairs]})

    return rows.groupBy("query_id").applyInPandas(link, "query_id long, a string, b string, level int")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, chunk_id, cluster): the least member reachable; label propagation with checkpoints and pointer jumps."""
    both = links.select("query_id", "a", "b").unionByName(links.select("query_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    label = checkpointed(nodes.select("query_id", "chunk_id", F.col("chunk_id").alias("cluster")))
    while True:  # labels only fall, so there is a fixed point
        near = both.join(label.select("query_id", F.col("chunk_id").alias("b"), F.col("cluster").alias("c")), ["query_id", "b"]).groupBy("query_id", F.col("a").alias("chunk_id")).agg(F.min("c").alias("c"))
        moved = label.join(near, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.least("cluster", F.coalesce("c", "cluster")).alias("new"), "cluster")
        jump = moved.select("query_id", F.col("chunk_id").alias("new"), F.col("new").alias("far"))
        moved = checkpointed(moved.join(jump, ["query_id", "new"], "left").select("query_id", "chunk_id", F.coalesce("far", "new").alias("new"), "cluster"))
        label = moved.select("query_id", "chunk_id", F.col("new").alias("cluster"))
        if moved.filter(F.col("new") != F.col("cluster")).isEmpty():
            return label


def components_by_query(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The same within queries of few chunks (after pre-ranking they are bounded): union-find in one pass, no iteration."""
    import pandas as pd

    def label(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        root = {c: c for c in nodes.chunk_id}

        def find(c: str) -> str:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for a, b in zip(links.a, links.b, strict=True):
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return pd.DataFrame({"query_id": nodes.query_id, "chunk_id": nodes.chunk_id, "cluster": [find(c) for c in nodes.chunk_id]})

    pairs = links.select(F.col("query_id").alias("q"), "a", "b").groupBy("q")
    return nodes.select("query_id", "chunk_id").groupBy("query_id").cogroup(pairs).applyInPandas(label, "query_id long, chunk_id string, cluster string")


def representatives(chunks: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """One row a cluster: representative (best relevance * weight * confidence * freshness, then least id), size, level, novelty."""
    worth = F.col("relevance") * F.col("weight") * F.col("confidence") * F.col("freshness")
    m = chunks.join(labels, ["query_id", "chunk_id"]).withColumn("worth", worth).withColumn("tokens", F.array_distinct(terms(content_key(F.col("content"), 1 << 30))))
    best = m.groupBy("query_id", "cluster").agg(F.min_by("chunk_id", F.struct(-F.col("worth"), "chunk_id")).alias("representative"), F.count(F.lit(1)).alias("size"))
    level = links.join(labels.withColumnRenamed("chunk_id", "a"), ["query_id", "a"]).groupBy("query_id", "cluster").agg(F.min("level").alias("level"))
    rep = best.join(m.select("query_id", F.col("chunk_id").alias("representative"), F.col("tokens").alias("own")), ["query_id", "representative"])
    other = m.select("query_id", "cluster", "chunk_id", "tokens").join(rep, ["query_id", "cluster"]).filter("chunk_id <> representative")
    union = F.size(F.array_union("own", "tokens"))
    alike = other.groupBy("query_id", "cluster").agg(F.max(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("own", "tokens")) / F.nullif(union, F.lit(0)))).alias("alike"))
    names = F.element_at(F.create_map(*(F.lit(x) for k, v in LEVELS.items() for x in (v, k))), F.coalesce("level", F.lit(4)))
    out = best.join(level, ["query_id", "cluster"], "left").join(alike, ["query_id", "cluster"], "left")
    return out.select("query_id", "cluster", "representative", "size", names.alias("level"), (1 - F.coalesce("alike", F.lit(0.0))).alias("novelty"))


def js_divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (base 2, 0..1) of term counts ``(keys, term, n)``; terms absent on a side add nothing there."""
    p = a.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys))).select(*keys, "term", "p")
    q = b.withColumn("q", F.col("n") / F.sum("n").over(W.partitionBy(*keys))).select(*keys, "term", "q")
    both = p.join(q, [*keys, "term"], "full").fillna(0.0, ["p", "q"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("m"))).otherwise(0.0)
    return both.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(part("p") + part("q")) / 2 / F.ln(F.lit(2.0)))).alias("js"))


def js_to_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The same of every group of ``a`` to one distribution ``b`` (term, n), which is not copied to the groups.

    What only ``b`` has adds ``ln 2`` times its share, and that share is what its terms in the group leave.
    """
    p = a.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys))).select(*keys, "term", "p")
    total = b.agg(F.sum("n").alias("total")).first()["total"] or 1
    q = b.select("term", (F.col("n") / F.lit(total)).alias("q"))
    both = p.join(q, "term", "left").fillna(0.0, ["q"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    here = F.sum(F.col("p") * F.ln(F.col("p") / F.col("m"))) + F.sum(F.when(F.col("q") > 0, F.col("q") * F.ln(F.col("q") / F.col("m"))).otherwise(0.0))
    ln2 = F.ln(F.lit(2.0))
    return both.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (here + ln2 * (1 - F.sum("q"))) / 2 / ln2)).alias("js"))
