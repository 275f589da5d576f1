"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

The sketch of a text grows with the text, the sketch of a union is the union of sketches, and the
share of one sketch found in another estimates containment however unequal the texts are. No hash above
the fraction is ever kept, so a short text may have none: beside the hashes stand the exact number of its
shingles and a digest of their whole set, which tell equal sets from others. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import _common as C

#: One hash in SCALE is kept.
SCALE = 4
SHINGLE = 5
LEAST = -(1 << 63)
ROWS_A_BUCKET = 2000
MAX_BUCKETS = 4096


def _with_sketch(df: DataFrame, text: str, name: str, words: int, scale: int) -> DataFrame:
    """Adds the sketch of a text column: struct of n, the number of distinct word shingles; whole, a digest of the set of their
    hashes; and hashes, those in the lowest 1 / scale of the 64-bit range, ascending."""
    at = C.free("_h", df.columns)
    split = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    df = df.withColumn(at, F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)))
    # each shingle's hash stands at its first word; the last words - 1 places have none, but for a text shorter than a shingle
    shingles = F.transform(at, lambda h, i: F.xxhash64(h, *(F.get(at, i + j) for j in range(1, words))))
    df = df.withColumn(at, F.array_sort(F.array_distinct(F.slice(shingles, 1, F.greatest(F.size(at) - (words - 1), F.lit(1))))))
    last = LEAST + (1 << 64) // scale - 1
    sketch = F.struct(F.size(at).cast("long").alias("n"), F.xxhash64(at).alias("whole"), F.filter(at, lambda h: h <= last).alias("hashes"))
    return df.withColumn(name, sketch).drop(at)


def with_sketch(df: DataFrame, text_col: str = "text", name: str = "sketch", words: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with its texts' sketches in column `name`: struct<n bigint, whole bigint, hashes array<bigint>>. Null and empty texts
    have n = 0 and no hashes; a text of fewer than `words` words is one shingle, and a short text may keep no hash.
    Equal texts have equal sketches; rows that repeat are rows of their own. Other columns pass through, whatever their
    names, but for one named `name`, which is replaced."""
    return _with_sketch(df, text_col, name, words, scale)


def _field(sketch: str | Column, name: str) -> Column:
    return (F.col(sketch) if isinstance(sketch, str) else sketch)[name]


def _same(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(_field(a, "whole") == _field(b, "whole"), F.lit(False))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity of two texts' sets of shingles, from 0 to 1: 1 if they are the same, which is known exactly, and never more than their
    numbers allow. Of different sets that keep no hash nothing more is known: 0."""
    x, y = _field(a, "hashes"), _field(b, "hashes")
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    n, m = _field(a, "n"), _field(b, "n")
    most = F.coalesce(F.least(n, m) / F.greatest(n, m, F.lit(1)), F.lit(1.0))
    return F.when(_same(a, b), F.lit(1.0)).when(union == 0, F.lit(0.0)).otherwise(F.least(both / F.greatest(union, F.lit(1)), most))


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none. Null if a keeps no hash, so that nothing can be told, unless
    the sets are the same."""
    x = _field(a, "hashes")
    share = F.when(F.size(x) > 0, F.size(F.array_intersect(x, _field(b, "hashes"))) / F.greatest(F.size(x), F.lit(1)))
    return F.when((_field(a, "n") == 0) | _same(a, b), F.lit(1.0)).otherwise(share)


def merged(sketches: str | Column) -> Column:
    """The sketch of a union of sets of shingles, from an array of sketches (an aggregate's collect_list, say). Its hashes are exactly those
    that the union's own sketch keeps; n and whole, which can't be told from parts, are null."""
    hashes = F.array_sort(F.array_distinct(F.flatten(F.transform(sketches, lambda s: s["hashes"]))))
    return F.struct(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("whole"), hashes.alias("hashes"))


def as_text(sketch: str | Column) -> Column:
    """16 hexadecimal digits each: the digest of the whole set, then every hash kept."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(digits(_field(sketch, "whole")), F.array_join(F.transform(_field(sketch, "hashes"), digits), ""))


def with_next(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with next_<column> for each column: that of the next row by descending id, null ids last and
    equal ids by their text's digest; after the last row comes the first. A column next_<column> is replaced; all others pass
    through, whatever their names.

    Rows are dealt to ranges of ids (of about ROWS_A_BUCKET rows, MAX_BUCKETS at most), so there is no
    window over the whole table. The first row of each range also goes to the range before it, as a guest.
    """
    place, order, guest, to = (C.free(n, docs.columns) for n in ("_place", "_order", "_guest", "_to"))
    n, least, _ = docs.agg(F.count("*"), F.min(id_col), F.max(id_col)).first()
    parts = max(1, min(MAX_BUCKETS, n // ROWS_A_BUCKET))
    bounds = docs.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 and least is not None else []
    bounds = F.array(*(F.lit(x) for x in sorted(set(bounds or []))))
    range_of = F.when(F.col(id_col).isNull(), F.lit(MAX_BUCKETS)).otherwise(F.size(F.filter(bounds, lambda x: x > F.col(id_col))) if parts > 1 else F.lit(0))
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.bitwise_not(F.coalesce(id_col, F.lit(0))).alias("down"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    keyed = docs.withColumns({place: range_of, order: rank})
    heads = sorted(tuple(r) for r in keyed.groupBy(place).agg(F.min(order).alias("head")).select(place, "head.*").collect())  # MAX_BUCKETS + 1 rows at most
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    guests = keyed
    if heads:
        first = docs.sparkSession.createDataFrame([(before[p], (none, down, digest)) for p, none, down, digest in heads], f"`{to}` int, `{to}_head` struct<none:boolean,down:bigint,digest:string>")
        match = F.col(order) == F.col(f"{to}_head")
        guests = keyed.join(F.broadcast(first), match).withColumn(place, F.col(to)).drop(*first.columns)
    every = keyed.withColumn(guest, F.lit(False)).unionByName(guests.withColumn(guest, F.lit(True)))
    window = Window.partitionBy(place).orderBy(guest, order)
    return every.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where(~F.col(guest)).drop(guest, place, order)


def edited_fingerprints(docs: DataFrame, words: int = SHINGLE, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch): each text, null as empty, with the text in
    which its last floor(n_chars / 3) code points give way to the first as many (or all) of the next
    document's (see with_next), and their sketches. One row per row of docs; other columns are not read."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = with_next(_with_sketch(d, "text", "sketch", words, scale), ("text", "sketch"))
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    d = _with_sketch(d.select("doc_id", "n_chars", "edited", "sketch", "next_sketch"), "edited", "edited_sketch", words, scale)
    return d.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
