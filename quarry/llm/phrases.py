"""Phrase mining: n-gram counts from word-id suffix arrays per shard, merged by key, and collocation scores.

Each task gathers its texts as shards of about ``_SHARD`` words: numbers of the shard's own words, with breaks between
pieces. Words are counted by language over all shards, those in ``least`` places or more get global numbers, all others
become breaks, as no candidate holds them. Then, for phrases of 2, 3, ... words:

1. in each shard the suffixes of the number sequence are sorted by their first words, by prefix doubling in numpy, and
   the intervals of suffixes whose common prefix is at least n words long are its phrases of n words, their lengths the counts;
2. the distinct phrases of a shard go, packed, to hash ranges of phrases, where counts are added up;
3. what reaches ``least`` is kept, and each shard gets a bit for each phrase that it sent. In the next round it only
   sends phrases whose two shorter parts were kept, as a phrase is never more frequent than its parts.

So a frequent word or phrase travels once a shard, whatever its count, and nothing is keyed by hashes: phrases are compared
by their numbers. Scores, cover by longer phrases and ranks are DataFrame operations on the phrases that were kept; joins
on the words of phrases are salted, and ranks are taken within parts of a language before they are taken within it. What
grows with the corpus is merged, never broadcast; only the starts of partitions and the totals of languages are sent.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count as often as they come;
ties go to the phrase that is first in the order of UTF-8 bytes; an empty table gives an empty result; other columns do
not matter. A text of any length is split between shards at the ends of pieces.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm._spark import drop, materialize, shuffle_partitions
from quarry.llm._text import mix
from quarry.llm.components import salted_join

_U64 = np.uint64
#: Words of a shard, and bytes of its distinct words, after which the next one begins.
_SHARD, _WORDS = 1 << 20, 64 << 20
#: What splits texts into pieces; words are runs of anything but spaces and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(0x0A if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))

_SHARDS = "shard long, langs array<string>, words array<string>, counts array<long>, of array<string>, totals array<long>, ids binary"


def _shards(docs: DataFrame, lang: str, text: str, limit: int) -> DataFrame:
    """Shards: the distinct words by language with their counts, the words of each language, word numbers (-1: a break)."""
    names = [c.split()[0] for c in _SHARDS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, numbers, ids = TaskContext.get().partitionId() << 33, count(), array("i")
        known: dict[str, defaultdict] = {}

        def ship() -> pa.RecordBatch:
            nonlocal shard, numbers, ids
            flat = np.frombuffer(ids, np.int32)
            found = np.bincount(flat[flat >= 0])
            langs, words, totals = [""] * len(found), [""] * len(found), []
            for name, own in known.items():
                for word, i in own.items():
                    langs[i], words[i] = name, word.decode()
                totals.append(int(found[np.fromiter(own.values(), np.int64, len(own))].sum()))
            row = [shard, langs, words, found.tolist(), list(known), totals, flat.tobytes()]
            del flat
            known.clear()
            shard, numbers, ids = shard + 1, count(), array("i")
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        size = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in (value.as_py() or "").encode("utf-8", "replace").translate(_LOWER).split(b"\n"):
                    words = piece.split()
                    if words:
                        own = known.setdefault(name, defaultdict(numbers.__next__))
                        before = len(own)
                        ids.extend(map(own.__getitem__, words))
                        ids.append(-1)
                        if len(own) > before:
                            size += len(piece)
                        if len(ids) >= limit or size >= _WORDS:
                            yield ship()
                            size = 0
        if len(ids):
            yield ship()

    return docs.select(F.coalesce(F.col(lang), F.lit("und")), F.col(text)).mapInArrow(run, _SHARDS)


def _vocabulary(shards: DataFrame, least: int, scratch: list[str]) -> DataFrame:
    """(lang, word, f, id) of the frequent words, numbered from 1 without gaps."""
    spark = shards.sparkSession
    each = shards.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w")).select(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    often = each.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    often = materialize(often.withColumn("at", F.monotonically_increasing_id()), scratch)
    part = F.shiftright("at", 33)
    first, offsets = 1, []
    for r in often.groupBy(part.alias("part")).agg(F.max(F.col("at").bitwiseAND((1 << 33) - 1)).alias("last")).orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], first))
        first += r["last"] + 1
    if first >= 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, first long"))  # as many rows as partitions
    return often.withColumn("part", part).join(starts, "part").select("lang", "word", "f", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


def _encoded(shards: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(shard, seq): the global numbers of its words as uint32; 0 stands for breaks and rare words, runs of it for one."""
    each = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words")).alias("at", "w")).select("shard", "at", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    known = each.join(vocabulary.hint("merge"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, pairs = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32), batch.column(2)[i].values
                table = np.zeros(int(ids.max()) + 2, "<u4")  # the last is that of breaks, -1
                table[pairs.field("at").to_numpy()] = pairs.field("id").to_numpy()
                seq = table[ids]
                seq = seq[(seq > 0) | np.append(True, seq[:-1] > 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([seq.tobytes()], pa.binary())], names=["shard", "seq"])

    return shards.select("shard", "ids").join(known.hint("merge"), "shard").select("shard", "ids", "known").mapInArrow(run, "shard long, seq binary")


class Suffixes:
    """The suffixes of a word-id sequence in the order of their first ``depth`` words, and their common prefixes."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        self.seq = np.append(seq, np.zeros(2 * depth, seq.dtype))  # ends with breaks
        rank, width = self.seq.astype(_U64), 1
        while width < depth:  # prefix doubling: of twice as many words by the ranks of both halves
            key = rank << _U64(32) | np.append(rank[width:], np.zeros(width, _U64))
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(len(key), _U64)
            rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])).astype(_U64)
            width *= 2
        order = order if depth > 1 else np.argsort(rank, kind="stable")
        self.order = order[self.seq[order] > 0]
        self.words = np.zeros(len(self.seq), np.int8)  # words to the next break, up to depth
        self.common = np.zeros(len(self.order), np.int8)  # words in common with the suffix before
        alive, same = self.seq > 0, np.append(False, np.ones(max(0, len(self.order) - 1), bool))[: len(self.order)]
        for d in range(depth):
            ahead = np.append(self.seq[d:], np.zeros(d, self.seq.dtype))
            alive = alive & (ahead > 0)
            self.words += alive
            at = ahead[self.order]
            same = same & np.append(False, at[1:] == at[:-1])[: len(at)]
            self.common += same

    def phrases(self, n: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of each distinct phrase of ``n`` words that may start at the places ``allowed``."""
        first = np.flatnonzero(self.common < n)
        counts, place = np.diff(np.append(first, len(self.order))), self.order[first]
        keep = self.words[place] >= n
        if allowed is not None:
            keep &= allowed[place]
        return place[keep], counts[keep]

    def grams(self, place: np.ndarray, n: int) -> np.ndarray:
        return self.seq[place[:, None] + np.arange(n)]

    def everywhere(self, place: np.ndarray, n: int) -> np.ndarray:
        """All places at which the phrases that start at ``place`` start."""
        first = np.flatnonzero(self.common < n)
        interval = np.empty(len(self.seq), np.int64)
        interval[self.order] = np.cumsum(self.common < n) - 1
        chosen = np.zeros(len(first) + 1, bool)
        chosen[interval[place]] = True
        out = np.zeros(len(self.seq), bool)
        out[self.order] = chosen[interval[self.order]]
        return out


def _slots(grams: np.ndarray, slots: int) -> np.ndarray:
    h = np.zeros(len(grams), _U64)
    for j in range(grams.shape[1]):
        h = mix(h * _U64(0xD1342543DE82EF95) + grams[:, j])
    return (h % _U64(slots)).astype(np.int64)


def _dealt(seq: np.ndarray, longest: int, slots: int, flags: list[list[tuple] | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The phrases of 2 + len(flags) words by slot: (slot, grams, counts). ``flags``: by round before, (slot, bits) of what was kept."""
    suffixes, allowed = Suffixes(seq, longest), None
    for n in range(2, 3 + len(flags)):
        place, counts = suffixes.phrases(n, allowed)
        grams = suffixes.grams(place, n)
        slot = _slots(grams, slots)
        order = np.argsort(slot, kind="stable")
        place, counts, grams, slot = place[order], counts[order], grams[order], slot[order]
        edges = np.searchsorted(slot, np.arange(slots + 1))
        if n < 2 + len(flags):
            kept = np.zeros(len(place), bool)
            for s, bits in flags[n - 2] or []:
                kept[edges[s] : edges[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[s + 1] - edges[s])
            starts = suffixes.everywhere(place[kept], n)
            allowed = starts & np.append(starts[1:], False)  # both parts of a longer phrase
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), grams[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]


def _postings(encoded: DataFrame, longest: int, slots: int, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                flags = [[(x["slot"], x["bits"]) for x in batch.column(2 + r)[i].as_py() or []] for r in range(rounds)]
                if not all(flags):
                    continue
                rows = [(s, shard, g.tobytes(), c.astype("<u4").tobytes()) for s, g, c in _dealt(np.frombuffer(batch.column(1)[i].as_buffer(), "<u4"), longest, slots, flags)]
                for a in range(0, len(rows), 64):
                    part = list(zip(*rows[a : a + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slot", "shard", "grams", "counts"])

    return encoded.mapInArrow(run, "slot int, shard long, grams binary, counts binary")


_KEPT = "shard long, slot int, bits binary, ids array<long>, f long"


def _kept(postings: DataFrame, n: int, least: int) -> DataFrame:
    """Of each slot: (ids, f) of the phrases that are frequent, and for each shard the bits of those that it sent."""
    names, kinds = [c.split()[0] for c in _KEPT.split(", ")], [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def reduce(slot: int, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda x: x[0])
        grams = np.concatenate([np.frombuffer(x[1], "<u4").reshape(-1, n) for x in found])
        counts = np.concatenate([np.frombuffer(x[2], "<u4") for x in found]).astype(np.int64)
        packed = [grams[:, j].astype(_U64) << _U64(32) | (grams[:, j + 1] if j + 1 < n else _U64(0)) for j in range(0, n, 2)]
        order = np.lexsort(packed[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for p in packed:
            new[1:] |= p[order[1:]] != p[order[:-1]]
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first)
        often = total >= least
        flag = np.empty(len(order), bool)
        flag[order] = often[np.cumsum(new) - 1]
        at, rows = 0, []
        for shard, own, _ in found:
            bits = flag[at : at + len(own) // (4 * n)]
            at += len(bits)
            if bits.any():
                rows.append((shard, slot, np.packbits(bits).tobytes(), None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=names)
        ids, total = grams[order[first[often]]].astype(np.int64), total[often]
        for a in range(0, len(ids), 100_000):
            part = ids[a : a + 100_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), k) for k in kinds[:3]), lists, pa.array(total[a : a + 100_000])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, found = None, []
        for batch in batches:
            for s, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != slot and found:
                    yield from reduce(slot, found)
                    found = []
                slot = s
                found.append(tuple(packed))
        if found:
            yield from reduce(slot, found)

    dealt = postings.repartition(shuffle_partitions(postings.sparkSession), "slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, _KEPT)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4, scratch: list[str] | None = None, shard: int = _SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id), phrases of 2 to ``longest`` words (ids, f), both in ``least`` places or more, and (lang, n) of all words."""
    scratch = [] if scratch is None else scratch
    first: list[str] = []
    slots = 1 << max(5, (4 * shuffle_partitions(docs.sparkSession) - 1).bit_length())
    shards = materialize(_shards(docs, lang, text, shard), first)
    totals = shards.select(F.explode(F.arrays_zip("of", "totals")).alias("t")).groupBy(F.col("t.of").alias("lang")).agg(F.sum("t.totals").alias("n"))
    totals = materialize(totals, scratch)
    vocabulary = materialize(_vocabulary(shards, least, scratch), scratch)
    marked = encoded = materialize(_encoded(shards, vocabulary), scratch)
    drop(docs.sparkSession, first)
    found = None
    for n in range(2, longest + 1):
        level = materialize(_kept(_postings(marked, longest, slots, n - 2), n, least), scratch)
        own = level.filter("ids is not null").select("ids", "f")
        found = own if found is None else found.unionByName(own)
        bits = level.filter("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("slot", "bits")).alias(f"kept{n}"))
        marked = marked.join(bits.hint("merge"), "shard")
    return vocabulary, found if found is not None else encoded.select(F.array(F.lit(0).cast("long")).alias("ids"), F.lit(0).cast("long").alias("f")).limit(0), totals


def _scored(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(ids, a, l, r, score): the lowest-scoring cut, the first of equals."""
    cuts = found.select("ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids) - k)"))
    cuts = salted_join(cuts, parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left", "ids")
    cuts = salted_join(cuts, parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right", "ids")
    score = F.expr("(cast(2000000 as decimal(38, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    low = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    return low.select("ids", "a", "low.l", "low.r", "low.score")


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4, cover: int = 80, top: int = 2000, shard: int = _SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases that no longer one covers.

    A phrase is covered if a longer one that holds it has at least ``cover`` percent of its count.
    """
    spark, scratch = docs.sparkSession, []
    vocabulary, found, totals = counts(docs, lang, text, least, longest, scratch, shard)
    parts = vocabulary.select(F.array("id").alias("ids"), "f").unionByName(found)
    inner = found.filter("size(ids) > 2").select("f", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))")).alias("ids"))
    within = inner.groupBy("ids").agg(F.max("f").alias("most"))
    covered = F.expr(f"cast(most as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(cover)}")
    left = materialize(_scored(found, parts).join(within.hint("merge"), "ids", "left").filter(~F.coalesce(covered, F.lit(False))).drop("most"), scratch)
    each = left.select("ids", F.posexplode("ids").alias("at", "id"))
    named = salted_join(each, vocabulary.select("id", "lang", "word"), "id", "ids")
    text_of = named.groupBy("ids").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = left.join(text_of.hint("merge"), "ids")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language, then of the language
    rows = rows.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(shuffle_partitions(spark))))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    result = materialize(rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    drop(spark, scratch)
    return result
