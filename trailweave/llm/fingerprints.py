"""Canonical exact document fingerprints (DataFrame and SQL functions only).

A text is brought to a canonical form - Unicode compatibility composition, full case
folding, white-space folding - and grouped by a 128-bit xxhash. Within an equal hash
bucket the canonical bytes themselves are compared; should two different forms ever
share a bucket, their fingerprints get an ordinal, so equal fingerprints mean equal
canonical bytes.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import partitions, written
from trailweave.operators.layout import range_of

#: Bucket boundaries kept on the driver at most.
MAX_BUCKETS = 65536
BUCKET_BYTES = 16 << 20
LAST = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, runs of white space as one blank, trimmed.

    The normaliser is the JVM's ICU, called through the SQL function ``java_method``.
    """

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    """Two xxhash64 values with independent seeds."""
    return F.xxhash64(F.lit("a"), canon), F.xxhash64(F.lit("b"), canon)


def _hex(h1: str, h2: str) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0"))


def crowded(marks: DataFrame) -> DataFrame:
    """The hash buckets (h1, h2) of ``marks`` (h1, h2, digest) that hold more than one digest.

    Copies collapse before the shuffle, which carries numbers and no texts; a hot text is
    one row for each task.
    """
    return marks.distinct().groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")


def collisions(hashed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Ordinals for different canonical texts in the hash buckets ``buckets`` (h1, h2).

    ``hashed`` has h1, h2, canon. Only texts in these buckets are shipped, and their bytes
    are compared. Returns h1, h2, digest (sha-256 of the text), ordinal.
    """
    forms = hashed.select("h1", "h2", "canon").join(buckets, ["h1", "h2"], "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon"))
    return forms.select("h1", "h2", F.unhex(F.sha2("canon", 256)).alias("digest"), (rank - 1).alias("ordinal"))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` to every row; null texts count as empty. All columns stay, but for
    one of that name, which gives way. Rows are shuffled only if hashes collide."""
    canon = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"]).alias("doc"), canonical(F.col(f"`{text}`")).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"))
    hashed = canon.select("doc", h1.alias("h1"), h2.alias("h2"), "canon")
    rows = hashed.withColumn("digest", F.unhex(F.sha2("canon", 256)))
    buckets = written(crowded(rows.select("h1", "h2", "digest")), "fingerprint-buckets")
    if buckets.isEmpty():
        return rows.select("doc.*", _hex("h1", "h2").alias("fingerprint"))
    out = rows.select("doc", "h1", "h2", "digest").join(collisions(hashed, buckets), ["h1", "h2", "digest"], "left")
    return out.select("doc.*", _spelled("h1", "h2", "ordinal").alias("fingerprint"))


def _spelled(h1: str, h2: str, ordinal: str) -> Column:
    suffix = F.when(F.col(ordinal) > 0, F.concat(F.lit("-"), F.col(ordinal).cast("string"))).otherwise("")
    return F.concat(_hex(h1, h2), suffix)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each of ``columns``: the value in the next row by descending
    doc_id; after the last row comes the first. Needs doc_id and text.

    Rows are cut into ranges of (doc_id, hash of the text), one shuffle; the first row of
    each range is also sent to the range before it, so no task sees more than its range. An
    id (or null) that many rows share fills several ranges; only rows equal in id and text
    are never parted. Null ids come last; rows with the same id are ordered by their hashes.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("mark", F.xxhash64("text"))
    size = keyed.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max("k").alias("top"), F.count("*").alias("rows")).first()
    if size["top"] is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    n = min(MAX_BUCKETS, max(4 * partitions(spark), (size["bytes"] or 0) // BUCKET_BYTES))
    # A row counts once for each mean length of text that it holds, so ranges are alike in bytes.
    unit = max(1, (size["bytes"] or 0) // size["rows"])
    units = keyed.select("k", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(4096), F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / unit).cast("int") + 1))))
    found = Counter(units.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"])
    cuts = sorted({*found, size["top"]})
    # A cut that is several quantiles is an id of many rows: so many ranges by their hashes.
    parts = [max(1, found[c]) for c in cuts]
    total = sum(parts)
    ahead = [total - x for x in accumulate(parts)]  # ranges in the order of rows: ids descend
    b = F.col("b")
    cut, m = F.get(_longs(cuts), b), F.get(_longs(parts), b)
    share = F.least(m - 1, F.floor((F.col("mark") / 2.0**64 + 0.5) * m).cast("long"))
    at = F.get(_longs(ahead), b) + F.when(F.col("k") == cut, share).otherwise(m - 1)
    keyed = keyed.withColumn("b", range_of(F.col("k"), cuts)).withColumn("range", at)
    first = keyed.groupBy("range").agg(F.max(F.struct("k", F.bitwise_not("mark").alias("m"))).alias("f")).collect()  # MAX_BUCKETS rows and few more
    first = {r["range"]: r["f"] for r in first}
    used = sorted(first)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    row = lambda values, none=0: F.get(_longs([values.get(r, none) for r in range(used[-1] + 1)]), F.col("range"))
    leads = (F.col("k") == row({r: f["k"] for r, f in first.items()})) & (F.bitwise_not("mark") == row({r: f["m"] for r, f in first.items()}))
    copies = F.array_compact(F.array(F.struct(F.lit(0).alias("ghost"), F.col("range").alias("range")), F.when(leads, F.struct(F.lit(1).alias("ghost"), row(before).alias("range")))))
    both = keyed.select(*docs.columns, "k", "mark", F.explode(copies).alias("at")).select(*docs.columns, "k", "mark", "at.*")
    w = Window.partitionBy("range").orderBy(F.col("ghost"), F.col("k").desc(), "mark")
    led = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.filter("ghost = 0").drop("k", "mark", "ghost", "range")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n/3) code points replaced by the first as many
    (or all) of the next document. ``near_edited`` and ``near_next`` are 1.0 for equal
    fingerprints, else 0.0: an exact digest knows no degrees. Edited texts and originals
    share the hash buckets, and in a bucket of several digests all bytes are compared. Null
    texts are empty, an empty table gives no rows, repeated rows stay. Columns other than
    doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("canon", canonical(F.col("text")))
    h1, h2 = wide_hash(F.col("canon"))
    base = base.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), "canon")
    rows = with_next(base.select("doc_id", "text", "h1", "h2", F.unhex(F.sha2("canon", 256)).alias("digest")), ["text", "h1", "h2", "digest"])
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = rows.select(
        "doc_id", "h1", "h2", "digest",
        n.cast("long").alias("n_chars"),
        ((F.col("h1") == F.col("next_h1")) & (F.col("h2") == F.col("next_h2")) & (F.col("digest") == F.col("next_digest"))).alias("same_next"),
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("changed"),
    )
    rows = rows.withColumn("e_canon", canonical(F.col("changed")))
    e1, e2 = wide_hash(F.col("e_canon"))
    changed = rows.select(e1.alias("h1"), e2.alias("h2"), F.col("e_canon").alias("canon"))
    rows = rows.select(
        "doc_id", "n_chars", "h1", "h2", "same_next", "digest",
        F.unhex(F.sha2("changed", 256)).alias("edited_sha256"),
        e1.alias("e1"), e2.alias("e2"), F.unhex(F.sha2("e_canon", 256)).alias("e_digest"),
    )
    rows = written(rows, "fingerprint-rows")
    marks = rows.select(F.explode(F.array(F.struct("h1", "h2", "digest"), F.struct(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("e_digest").alias("digest")))).alias("x")).select("x.*")
    buckets = written(crowded(marks), "fingerprint-buckets")
    if buckets.isEmpty():
        rows = rows.withColumns({"ordinal_digest": F.lit(0), "ordinal_e_digest": F.lit(0)})
    else:
        odd = written(collisions(base.select("h1", "h2", "canon").unionByName(changed), buckets), "fingerprint-ordinals")
        for a, b, d in (("h1", "h2", "digest"), ("e1", "e2", "e_digest")):
            rows = rows.join(odd.toDF(a, b, d, f"ordinal_{d}"), [a, b, d], "left")
    same = (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")) & (F.col("digest") == F.col("e_digest"))
    return rows.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        _spelled("h1", "h2", "ordinal_digest").alias("fingerprint"),
        _spelled("e1", "e2", "ordinal_e_digest").alias("edited_fingerprint"),
        same.cast("double").alias("near_edited"),
        F.col("same_next").cast("double").alias("near_next"),
    )
