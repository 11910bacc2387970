"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base kinds (fixed patterns, leftmost non-overlapping): ``assign`` (a key word, ``:`` or ``=`` and a value of
12 or more characters), ``access`` (``AKIA`` identifiers of 18 or more) and ``hex`` (16 or more hex digits).

Multipart linking looks for credentials whose parts are each too weak to report: identifiers (``user``,
``client_id``, ``access_key_id`` and the like with a value, or access ids), secrets (values of 6 to 11
characters behind a key word, base spans, or 20 and more characters of mixed case and digits) and endpoints
(URLs with a host, ``host=...``). Every identifier opens a scope of ``scope`` code points before and behind
it; parts are joined to the scopes that their intervals meet, as an equi-join on cells of that width with the
interval condition behind it. A weak secret is reported when a base access id shares its scope, or a weak identifier
and an endpoint do; a weak identifier or endpoint when it takes part in such a triple. Parts of one kind do
not overlap and have three characters or more, so a scope meets a bounded number of parts and the join's
output grows in proportion to the text.

Native: DataFrame functions only. The text is read by one scan, into spans; what is joined is spans.

Defined results: a null text is empty; rows are judged one by one (repeated rows get equal results, a null
key is kept); an empty table gives an empty result; other columns do not matter. Positions are code points,
ends exclusive; spans are ordered by start, then kind as listed in ``KINDS``, then end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.control import let
from quarry.llm._spark import materialize

KINDS = ["assign", "access", "hex", "weak_secret", "weak_id", "endpoint"]
_KEY = r"((?i:password|passwd|secret|token|api_?key))"
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = _KEY + _VALUE
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Only at the start of a run; the possessive look-aheads stop at the first letter or digit of their kind, so they are linear.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
IDENTIFIER = r"""(?<![A-Za-z0-9])(?i:user(?:name|_?id)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
ENDPOINT = r"""(?i:(?:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)(?::[a-z]+)?://[a-z0-9][^\s"'<>]{3,}|(?<![a-z0-9])(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.-]{4,})"""


#: Code points of a block that redaction looks at at once.
_BLOCK = 4096
_PART = "array<struct<kind:int,pos:int,skip:int,len:int,value:int>>"


def _matches(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """All matches: number, code points between the match before and this one, length, length of group 2; none where ``gate`` is false."""
    p = F.lit(pattern)
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    skips = F.transform(F.slice(pieces, 1, F.size(whole)), lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n")))
    value = F.transform(F.regexp_extract_all(text, p, F.lit(2)), lambda m: F.length(m)) if pattern == ASSIGN else F.transform(whole, lambda m: F.length(m))
    lengths = F.zip_with(F.transform(whole, lambda m: F.length(m)), value, lambda a, b: F.struct(a.alias("n"), b.alias("v")))
    found = F.zip_with(skips, lengths, lambda s, m: F.struct(F.lit(kind).alias("kind"), s["i"].alias("pos"), s["n"].alias("skip"), m["n"].alias("len"), m["v"].alias("value")))
    return F.when(gate & F.regexp_like(text, p), found).otherwise(F.array().cast(_PART)).cast(_PART)


def _parts(docs: DataFrame, carry: tuple[str, ...], text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))  # what every match of these patterns holds
    gates = {ASSIGN: named, ACCESS: F.contains(t, F.lit("AKIA")), HEX: F.lit(True), MIXED: F.lit(True), IDENTIFIER: named, ENDPOINT: named}
    kept = [F.col(c) for c in carry]
    return materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*kept).alias("_carry"), F.concat(*(_matches(t, p, k, g) for k, (p, g) in enumerate(gates.items()))).alias("_parts")))


def _spans(parts: DataFrame) -> DataFrame:
    """Rows (_row, kind, start, end) of every match that a base kind or the linking can use."""
    p = parts.select("_row", F.explode("_parts").alias("p")).select("_row", "p.*")
    upto = W.partitionBy("_row", "kind").orderBy("pos")
    p = p.withColumn("end", F.sum(F.col("skip") + F.col("len")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("len"))
    weak = (F.col("kind") == 0) & (F.col("value") < 12)
    return materialize(p.filter(~weak | (F.col("value") >= 6)).select("_row", F.when(weak, 3).otherwise(F.col("kind")).alias("kind"), "start", "end"))


def link(spans: DataFrame, scope: int = 400) -> DataFrame:
    """The weak spans of multipart credentials: (_row, kind, start, end), each once."""
    cell = lambda c: F.floor(c / F.lit(scope)).cast("int")
    ids = spans.filter(F.col("kind").isin(1, 4)).select("_row", F.col("kind").alias("id_kind"), F.col("start").alias("id_start"), F.col("end").alias("id_end"))
    ids = ids.withColumn("id_cell", cell(F.greatest(F.col("id_start") - scope, F.lit(0)))).withColumn("cell", F.explode(F.sequence("id_cell", cell(F.col("id_end") + scope))))
    others = spans.filter(F.col("kind").isin(0, 2, 3, 5)).withColumn("own_cell", cell(F.col("start"))).withColumn("cell", F.explode(F.sequence("own_cell", cell(F.col("end")))))
    near = (F.col("start") <= F.col("id_end") + scope) & (F.col("end") >= F.col("id_start") - scope)
    apart = (F.col("start") >= F.col("id_end")) | (F.col("end") <= F.col("id_start"))
    met = ids.join(others, ["_row", "cell"]).filter(near & apart & (F.col("cell") == F.greatest("id_cell", "own_cell")))  # once, in the first cell of both
    scope_of = W.partitionBy("_row", "id_kind", "id_start", "id_end")
    met = met.withColumn("secret", F.max(F.col("kind") != 5).over(scope_of)).withColumn("endpoint", F.max(F.col("kind") == 5).over(scope_of))
    whole = met.filter(F.col("secret") & (F.col("endpoint") | (F.col("id_kind") == 1)))
    both = F.array(F.struct("kind", "start", "end"), F.struct(F.col("id_kind").alias("kind"), F.col("id_start").alias("start"), F.col("id_end").alias("end")))
    return whole.select("_row", F.explode(both).alias("s")).select("_row", "s.*").filter("kind >= 3").distinct()


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", scope: int = 400) -> DataFrame:
    """Of every row ``_carry``, a struct of its ``carry`` columns, and ``_spans``, a sorted array of structs (start, kind, end)."""
    parts = _parts(docs, carry, text)
    spans = _spans(parts)
    found = spans.filter("kind < 3").unionByName(link(spans, scope)).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    has = F.size("_parts") > 0
    hit = parts.filter(has).join(found, "_row", "left").select("_carry", F.coalesce("spans", none).alias("_spans"))
    return hit.unionByName(parts.filter(~has).select("_carry", none.alias("_spans")))


def _say(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and positions by row, from ``scan``."""
    s = F.col("_spans")
    base = F.filter(s, lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return scanned.select(F.col("_carry")[key].alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_say(base), 256).alias("base_sha256"), _say(s).alias("spans"))


def _latest(ends: Column, n: Column) -> Column:
    """The largest end up to each place, by doubling: every step looks back twice as far."""
    back = lambda of, k: F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2.0), k).cast("int")), of), 1, n)
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), ends, lambda of, k: F.zip_with(of, back(of, k), lambda a, b: F.greatest(a, b)))


def redact(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The carried columns, every span (overlapping ones as one) of ``text`` replaced by ``mask``.

    What lies between spans is cut from blocks of the text, of which each piece reads only its own. So the work is in
    proportion to the text and to the spans times their logarithm, for very long texts with many spans too; a null text stays null.
    """
    t, s, block = F.col("_carry")[text], F.col("_spans"), F.lit(_BLOCK)
    part = lambda c: F.floor(c / block).cast("int")

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        cut = lambda i: F.coalesce(F.substring(F.get(blocks, i), F.greatest(start - i * block, F.lit(0)) + 1, F.least(end - i * block, block) - F.greatest(start - i * block, F.lit(0))), F.lit(""))
        return F.when(end <= start, "").otherwise(F.array_join(F.transform(F.sequence(part(start), part(end - 1)), cut), ""))

    def masked(blocks: Column, latest: Column, n: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), latest), 1, n)
        gaps = F.filter(F.zip_with(before, s, lambda b, x: F.struct(b.alias("start"), x["start"].alias("end"))), lambda g: g["end"] >= g["start"])
        first = F.array_join(F.transform(gaps, lambda g: piece(blocks, g["start"], g["end"])), mask)
        return F.concat(first, F.lit(mask), piece(blocks, F.element_at(latest, -1), F.length(t)))

    # bound once: a column that a lambda names would be made again for every element
    found = let(F.size(s), lambda n: let(_latest(F.transform(s, lambda x: x["end"]), n), lambda latest: let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), lambda blocks: masked(blocks, latest, n))))
    return scanned.select(F.col("_carry").withField(text, F.when(F.size(s) > 0, found).otherwise(t)).alias("_carry")).select("_carry.*")
