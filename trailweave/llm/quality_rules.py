"""Quality rules kept as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger stores the measurements and
one failure bit per rule. A policy is a named, versioned mask over those bits, so a
new policy or an ablation never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Bit number -> (name, SQL condition over the measurements that means failure).
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the filter: the rules (by name) that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(n for n, _ in RULES))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text.

    A null text counts as empty: all measurements are 0. ``n_words`` counts runs of
    non-space characters; ``n_repeat_words`` counts the words inside five-word windows
    that occur at least twice in the text. A hash pass screens texts without any
    repeated window; the rest compare the windows' words themselves, so hash
    collisions cannot change a count. A document column with the name of a measurement or
    of the ledger's other columns gives way to it.
    """
    own = {"_t", "_w", "_l", "_g", "_p", "failures", "kept", "policy", *MEASURES}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    a = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    a = a.select(
        *keep,
        "_t",
        F.array_remove(F.split("_t", SPACES), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    no_symbols: Column = F.col("_t")
    for s in SYMBOLS:
        no_symbols = F.replace(no_symbols, F.lit(s), F.lit(""))
    a = a.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(no_symbols)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(_w) > 5 THEN transform(sequence(1, size(_w) - 4), i -> xxhash64(element_at(_w, i), "
            "element_at(_w, i + 1), element_at(_w, i + 2), element_at(_w, i + 3), element_at(_w, i + 4))) END"
        ).alias("_g"),
    )
    # Only texts in which a window hash comes twice sort their windows.
    a = a.withColumn(
        "_g",
        F.expr(
            "CASE WHEN size(array_distinct(_g)) < size(_g) THEN "
            "sort_array(transform(sequence(1, size(_w) - 4), i -> struct(array_join(slice(_w, i, 5), ' ') AS g, i AS i))) END"
        ),
    )
    a = a.withColumn(
        "_p",
        F.expr(
            "CASE WHEN _g IS NOT NULL THEN sort_array(filter(transform(_g, (x, k) -> "
            "CASE WHEN x.g = get(_g, k - 1).g OR x.g = get(_g, k + 1).g THEN x.i END), i -> i IS NOT NULL)) END"
        ),
    )
    covered = F.expr(
        "CASE WHEN size(_p) > 0 THEN aggregate(sequence(1, size(_p)), 0L, "
        "(s, k) -> s + CASE WHEN k = size(_p) THEN 5 ELSE least(5, get(_p, k) - get(_p, k - 1)) END) ELSE 0L END"
    )
    a = a.withColumn("n_repeat_words", covered.cast("long"))
    # The one-row generator keeps later filters above it: pushed below, they would evaluate
    # the array expressions again inside one another.
    return a.select(*keep, F.inline(F.array(F.struct(*MEASURES))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements plus ``failures``: bit i is set when rule i fails.

    Empty tables give an empty ledger; repeated rows stay, each with its own entry.
    """
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("failures", bits)


def stored(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ledger of ``docs`` written to ``path`` without texts: policies and ablations of any
    version read it and no text again."""
    ledger(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), text).select(key, *MEASURES, "failures").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def fails(policy: Policy) -> Column:
    """True where the ledger row fails the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Add ``kept`` and ``policy`` to a ledger."""
    return entries.withColumn("kept", ~fails(policy)).withColumn("policy", F.lit(policy.version))


def keep(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with exactly their own columns whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text"))
    return ledger(rows).filter(~fails(policy)).select("doc.*")


def ablations(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """What each rule of a policy does: rows that fail it, rows that only it rejects,
    and the policy's rejections with and without it. One pass over the ledger; the
    failure masks are grouped first, so at most 2**rules groups reach the report."""
    masks = entries.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    out = []
    for r in policy.rules:
        bit = 1 << names.index(r)
        has = F.col("m").bitwiseAND(F.lit(bit).cast("long")) != 0
        zero = F.lit(0).cast("long")
        out.append(
            F.struct(
                F.lit(r).alias("rule"),
                F.coalesce(F.sum(F.when(has, F.col("n"))), zero).alias("failed"),
                F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), zero).alias("only_this"),
                F.coalesce(F.sum(F.when(F.col("m") != 0, F.col("n"))), zero).alias("rejected"),
                F.coalesce(F.sum(F.when((F.col("m") != 0) & (F.col("m") != bit), F.col("n"))), zero).alias("rejected_without"),
            )
        )
    return masks.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")
