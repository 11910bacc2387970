"""Text functions as Column expressions; white space is the ASCII class unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType


_MARK = "\x01"
#: Texts of a batch that are Python strings at once.
_SLICE = 256


def _replace(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


_TAGS = [(r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " ")]
_ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\f\x0b"))


def clean_html(c: Column) -> Column:
    """Text of HTML with its paragraphs kept."""
    return trim(_replace(c, *_TAGS, *_ENTITIES, (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def strip_html(c: Column) -> Column:
    """Text of HTML on one line."""
    return trim(_replace(c, *_TAGS, *_ENTITIES, (r"[ \t\n\r\f\x0B]+", " ")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def token_estimate(c: Column, least: int = 1) -> Column:
    n = F.size(F.split(trim(c), r"[ \t\n\r\f\x0B]+"))  # what is trimmed has no empty words
    return F.when(trim(c) == "", F.lit(0)).otherwise(F.greatest(F.lit(least), F.ceil(n * F.lit(1.33)))).cast("long")


def truncate_to_budget(c: Column, budget: int) -> Column:
    keep = int(budget / 1.33)
    w = words(c)
    return F.when(F.size(w) <= keep, c).otherwise(F.concat(F.array_join(F.slice(w, 1, keep), " "), F.lit("...")))


def embedder_tokens(c: Column) -> Column:
    """What the hash embedding counts: lower-case runs of letters, digits, dots and dashes, of three characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s.-]", " "), r"[ \t\n\r\f\x0B]+"), lambda t: F.length(t) > 2)


def apostrophe_words(c: Column) -> Column:
    """Lower-case alphanumeric words with an inner apostrophe kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def terms(c: Column, longer_than: int = 3, stop: list[str] | None = None) -> Column:
    """Lower-case alphanumeric tokens longer than a bound and not stop words, in order, with repeats."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) > longer_than) & ~t.isin(*stop) if stop else F.length(t) > longer_than)


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def content_key(c: Column, limit: int = 2000) -> Column:
    """Lower case, other than ``[\\w ./:-]`` to spaces, collapsed; the first ``limit`` characters."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s./:-]", " "), r"[ \t\n\r\f\x0B]+", " ")
    return F.substring(F.trim(spaced), 1, limit)


@pandas_udf(StringType())
def _decomposed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD of lower-cased text."""
    for series in parts:
        yield series.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


@arrow_udf(StringType())
def _composed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC; of a batch a few texts at a time are Python's."""
    for texts in parts:
        done = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.slice(a, _SLICE).to_pylist()], texts.type) for a in range(0, max(1, len(texts)), _SLICE)]
        yield pa.concat_arrays(done)


# as deterministic it would be computed again, by workers of its own, for every filter that is pushed below it
_composed = _composed.asNondeterministic()


def composed(c: Column) -> Column:
    """Compatibility composition; only texts with letters beyond ASCII leave the JVM for it."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_composed(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def decomposed(c: Column) -> Column:
    """Lower case in compatibility decomposition; only texts with letters beyond ASCII leave the JVM for it."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(_decomposed(F.when(~c.rlike(r"^\p{ASCII}*$"), F.lower(c))))


def _marked_letters() -> dict[str, str]:
    """Lower-case letters that decompose into an ASCII letter and marks, by their letter; made by rule."""
    out = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        d = unicodedata.normalize("NFKD", c)
        if c == c.lower() and len(d) > 1 and d[0].isascii() and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:]):
            out[c] = d[0]
    return out


_MARKED = _marked_letters()


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_\s./:-]+", " "), r"[ \t\n\r\f\x0B]+", " "))


def normalized_text(c: Column) -> Column:
    """Lower case, decomposed, other than ASCII letters, digits, white space and ``_./:-`` to spaces, collapsed."""
    return _plain(decomposed(c))


def folded(c: Column) -> Column:
    """The same without leaving the JVM, so that it works inside arrays: of what decomposes it knows letters with marks.

    The class of these letters is tried one by one, so no ASCII letter gets that far.
    """
    letters = "".join(_MARKED)
    return _plain(F.translate(F.regexp_replace(F.lower(c), rf"(?=[^\x00-\x7F])([{letters}])", "$1 "), letters, "".join(_MARKED.values())))


def matched_question(c: Column) -> Column:
    """A question as it is compared with others: NFKC, quotes and dashes folded, one space, lower case."""
    plain = F.translate(composed(c), "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(plain, r"[ \t\n\r\f\x0B]+", " ")))


def first_sentence(c: Column, limit: int = 240) -> Column:
    sentence = F.element_at(F.split(F.regexp_replace(c, r"\.[ \t\n\r\f\x0B]+", "." + _MARK), _MARK), 1)
    return F.substring(F.when(sentence != "", sentence).otherwise(c), 1, limit)


def paragraphs(c: Column) -> Column:
    """Parts at blank lines and at sentence ends before a capital or digit."""
    marked = F.regexp_replace(F.regexp_replace(c, r"\n{2,}", _MARK), r"\.[ \t\n\r\f\x0B]+([A-Z0-9])", "." + _MARK + "$1")
    parts = F.filter(F.transform(F.split(marked, _MARK), trim), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def pack_chunks(c: Column, least: int = 500, most: int = 1000) -> Column:
    """Chunk texts: paragraphs packed in order, flushed before ``most`` tokens and at three quarters of it."""
    state = "struct<done:array<string>,cur:array<string>,tok:bigint>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).cast("long").alias("tok")).cast(state)
    flush = lambda s: F.concat(s["done"], F.array(F.array_join(s["cur"], "\n\n")))

    def step(s: Column, x: Column) -> Column:
        p, n = x["p"], x["n"]
        over = (s["tok"] > 0) & (s["tok"] + n > most)
        done = F.when(over, flush(s)).otherwise(s["done"])
        cur = F.when(over, F.array(p)).otherwise(F.concat(s["cur"], F.array(p)))
        tok = F.when(over, n).otherwise(s["tok"] + n)
        full = (tok >= least) & (tok >= 0.75 * most)
        return F.struct(
            F.when(full, F.concat(done, F.array(F.array_join(cur, "\n\n")))).otherwise(done).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(cur).alias("cur"),
            F.when(full, F.lit(0).cast("long")).otherwise(tok).alias("tok"),
        ).cast(state)

    sized = F.transform(paragraphs(c), lambda p: F.struct(p.alias("p"), token_estimate(p).alias("n")))
    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["cur"]) > 0, flush(s)).otherwise(s["done"]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient, 0 if either set is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0)))


def item_parts(title: Column, summary: Column, text: Column) -> Column:
    """Title, summary and text of an item, each different part once, by blank lines."""
    parts = F.array_distinct(F.filter(F.array(title, summary, text), lambda p: p.isNotNull() & (p != "")))
    return F.array_join(parts, "\n\n")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 code units of BMP text."""
    codes = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))).cast("long"))
    codes = F.when(F.length(c) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def item_id(source: Column, key: Column) -> Column:
    return F.concat(source, F.lit(":"), F.lower(F.conv(fnv1a(key).cast("string"), 10, 36)))
