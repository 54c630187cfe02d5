"""Similarity join on word shingles with Bayesian candidate pruning.

Texts with the same words are one class. Classes that agree in a band of four MinHash
values are candidates; a pair belongs to the first band it shares. Candidates compare
their MinHash values in steps of sixteen and are dropped once the posterior probability
of reaching the threshold is below a tolerance; the rest are verified on their whole
shingle sets. Large buckets are cut into pairs of blocks, and links are counted where
they are verified, so no list of all pairs of a group ever leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W
from trailweave.llm.common import partitions, swept, written
from trailweave.llm.sieve import maybe, sieve
from trailweave.operators import layout

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 4: a pair at the threshold shares none with probability 5e-8.
HASHES, ROWS = 128, 4
BANDS, STEP, TOLERANCE = HASHES // ROWS, 16, 1e-6
#: Classes and shingles of a block of a large bucket, about; one class may have more shingles.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Shingles that are columns of a bit table at once.
COLUMNS = 1 << 15


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return (rng.integers(1 << 31, size=HASHES, dtype=np.uint32) << 1) | 1, rng.integers(1 << 32, size=HASHES, dtype=np.uint32)


def shingles(texts: list[str], memo: W.WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. A text of one to four words is
    one shingle; a text without words has none."""
    toks = [W.words(t) for t in texts]
    lens = [len(t) for t in toks]
    h = np.fromiter((memo[w] for t in toks for w in t), dtype=np.uint64, count=sum(lens))
    k = np.uint64(0x9E3779B97F4A7C15)
    out, at = [], 0
    mixed = h.copy()
    for i in range(1, SHINGLE):  # the hash of the SHINGLE words that start here
        if i < len(h):
            mixed[:-i] = mixed[:-i] * k + h[i:]
    for n in lens:
        if n >= SHINGLE:
            s = mixed[at : at + n - SHINGLE + 1]
        elif n:
            s = np.array([n], dtype=np.uint64)
            for x in h[at : at + n]:
                s = s * k + x
        else:
            s = h[:0]
        s = s ^ (s >> np.uint64(32))
        s = s * np.uint64(0xD6E8FEB86659FD93)
        out.append(np.unique(s ^ (s >> np.uint64(32))))
        at += n
    return out


def signature(s: np.ndarray) -> bytes:
    """HASHES MinHash values of 16 bits."""
    a, b = _permutations()
    h = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(low, (h[i : i + 2048, None] * a + b).min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes()


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For STEP, 2*STEP, ... compared values: the fewest matches with which a pair stays.

    With a uniform prior the similarity after m matches of n is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(sig: np.ndarray, side: np.ndarray, band: int, threshold: float, tolerance: float = TOLERANCE, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block that this band owns and that outlive the pruning. Sides 1 and 2
    are paired with each other, side 0 with itself; rows of one ``label`` are not paired."""
    if side[0]:
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 1), np.flatnonzero(side == 2), indexing="ij"))
    else:
        i, j = np.triu_indices(len(sig), 1)
    if label is not None:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    least, hits = least_matches(threshold, tolerance), np.zeros(len(i), dtype=np.int32)
    for k in range(HASHES // STEP):
        part = sig[:, k * STEP : (k + 1) * STEP]
        hits = hits + (part[i] == part[j]).sum(1)
        stay = hits >= least[k]
        if not stay.all():
            i, j, hits = i[stay], j[stay], hits[stay]
        if not len(i):
            return i, j
    bands = sig.view(np.uint64)
    own = (bands[i] == bands[j]).argmax(1) == band
    return i[own], j[own]


def _groups(batches: Iterator, key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with the same key, and where each group starts; input is sorted by key."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        k = t.column(key).to_numpy()
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        begin = 0
        if len(edges):
            yield t.slice(0, edges[-1]), np.concatenate([[0], edges])
            begin = edges[-1]
        rest = t.slice(begin)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _hashed(docs: DataFrame) -> DataFrame:
    def run(batches):
        memo = W.WordHashes()
        for ids, marks, texts in W.chunks(batches, "doc_id", "mark", "text"):
            sets = shingles(texts, memo)
            keys = [xxhash.xxh3_128_digest(" ".join(W.words(t))) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int64()), "cid": pa.array(keys, pa.binary()), "n_shingles": pa.array([len(s) for s in sets], pa.int32()), "sig": pa.array([signature(s) if len(s) else None for s in sets], pa.binary())}
            )

    return _marked(docs).mapInArrow(W.released(run), "doc_id long, mark long, cid binary, n_shingles int, sig binary")


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _pruned(blocks: DataFrame, threshold: float) -> DataFrame:
    """For every class with candidates left in a block: its partners there (each pair once).
    With a column ``label``, only pairs of different labels."""
    labelled = "label" in blocks.columns

    def run(batches):
        for t, edges in _groups(batches, "blk"):
            cid, side, band = t.column("cid").to_pylist(), t.column("side").to_numpy(), t.column("band").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            blk = t.column("blk").to_numpy()
            label = np.unique(np.array(t.column("label").to_pylist(), dtype=object), return_inverse=True)[1] if labelled else None
            out = ([], [], [])
            for a, b in zip(edges, np.append(edges[1:], len(t))):
                if b - a < 2:
                    continue
                i, j = survivors(sig[a:b], side[a:b], band[a], threshold, label=label[a:b] if labelled else None)
                if not len(i):
                    continue
                partners: dict[int, list] = {}
                for x, y in zip((i + a).tolist(), (j + a).tolist()):
                    partners.setdefault(x, []).append(cid[y])
                    partners.setdefault(y, [])
                for x, p in partners.items():
                    for col, v in zip(out, (int(blk[a]), cid[x], p)):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_pydict({"blk": pa.array(out[0], pa.int64()), "cid": pa.array(out[1], pa.binary()), "partners": pa.array(out[2], pa.list_(pa.binary()))})

    return blocks.mapInArrow(W.released(run), "blk long, cid binary, partners array<binary>")


def _verified(blocks: DataFrame, threshold: float, count: bool = True) -> DataFrame:
    """Exact links of each block: per class the copies it links to, and a class that all
    linked classes of its part of the block share. Without ``count`` pairs that are connected
    already are not compared, and the numbers are of those that were."""

    def run(batches):
        memo = W.WordHashes()
        for t, edges in _groups(batches, "blk"):
            cols = [t.column(c).to_pylist() for c in ("cid", "partners", "size", "text")]
            out = ([], [], [], [])
            for a, b in zip(edges, np.append(edges[1:], len(t))):
                rows = {c: (p, n, x) for c, p, n, x in zip(*(col[a:b] for col in cols))}  # a copy of a row counts once
                for row in _links(rows, memo, threshold, count):
                    for col, v in zip(out, row):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_pydict({"cid": pa.array(out[0], pa.binary()), "links": pa.array(out[1], pa.int64()), "classes": pa.array(out[2], pa.int64()), "root": pa.array(out[3], pa.binary())})

    return blocks.mapInArrow(W.released(run), "cid binary, links long, classes long, root binary")


def _links(rows: dict, memo: W.WordHashes, threshold: float, count: bool = True):
    names = sorted(rows)
    at = {c: i for i, c in enumerate(names)}
    sets = shingles([rows[c][2] for c in names], memo)
    size = np.array([len(s) for s in sets])
    copies = np.array([rows[c][1] for c in names], dtype=np.int64)
    links, classes, root = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64), list(range(len(names)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = [(at[c], at[p]) for c in names for p in rows[c][0] if p in at]
    turns = [pairs]
    if not count:  # first a pair for each class, then what these have not connected
        seen: set[int] = set()
        lead = [p for p in pairs if not seen.issuperset(p) and not seen.update(p)]
        turns = [lead, pairs]
    for k, turn in enumerate(turns):
        turn = [(i, j) for i, j in turn if find(i) != find(j)] if k else turn
        if not turn:
            continue
        left, right = (np.array(x, dtype=np.int64) for x in zip(*turn))
        inter = _overlaps(sets, left, right)
        good = inter >= threshold * (size[left] + size[right] - inter) - 1e-9
        left, right = left[good], right[good]
        for i, j in ((left, right), (right, left)):
            np.add.at(links, i, copies[j])
            np.add.at(classes, i, 1)
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    for c in names:
        i = at[c]
        if classes[i]:
            yield c, int(links[i]), int(classes[i]), names[find(i)]


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets. Sets are rows of bits over the block's
    shingles, COLUMNS of them at a time, so memory grows with the texts and not with
    texts times shingles."""
    out = np.zeros(len(left), dtype=np.int64)
    if len(left) < 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], dtype=np.int64)
    used = np.unique(np.concatenate([left, right]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used), dtype=np.int32), [len(sets[i]) for i in used])
    place = np.concatenate([sets[i] for i in used])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    place = np.cumsum(np.append(False, place[1:] != place[:-1]), dtype=np.int32)  # equal hashes, one column
    del order
    i, j = row[left], row[right]
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, (c, c + COLUMNS))
        wide = min(COLUMNS, -(-(int(place[b - 1]) - c + 1) // 64) * 64)
        flat = np.zeros((len(used), wide), dtype=bool)
        flat[owner[a:b], place[a:b] - c] = True
        bits = np.packbits(flat, axis=1).view(np.uint64)
        del flat
        step = max(1, (1 << 21) // bits.shape[1])
        for k in range(0, len(i), step):
            out[k : k + step] += np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.int64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): node, label (the least node). Labels go along edges
    and then jump to their label's label, so rounds grow with the logarithm of a chain. Nodes
    with very many edges get their labels by broadcast. Both moves are written, so that no plan
    holds the other's joins. Labels that no edge changes are the least nodes."""
    one = edges.filter("a <> b").select("a", "b")
    both = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    few = written(layout.hubs(both, "b").select("b"), "cc-hubs")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = layout.hub_join(both, "b", labels.withColumnRenamed("node", "b"), few).groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        step = written(step, "cc-step")
        if step.filter("old <> label").isEmpty():
            swept(edges.sparkSession)
            return labels
        step = layout.hub_join(step.drop("old"), "label", labels.select(F.col("node").alias("label"), F.col("label").alias("above")), layout.hubs(labels, "label"), "left")
        labels = written(step.select("node", F.least("label", "above").alias("label")), "cc-labels")


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hashed rows; the classes of rows with the same words; and the classes of each bucket
    (bucket, band, n, nb: number of blocks, cid, sig)."""
    hashed = written(_hashed(docs), "join-hashed")
    classes = written(
        hashed.filter("n_shingles > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("size"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")),
        "join-classes",
    )
    bands = classes.select("cid", "n_shingles", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> struct(b AS band, substring(sig, b * 8 + 1, 8) AS v))")).alias("x"))
    bands = bands.select("cid", "n_shingles", F.col("x.band").alias("band"), F.xxhash64("x.band", "x.v").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("cid")).alias("f1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("f2")).filter("n > 1")
    # Buckets with the same members are one: the one of the least band stays.
    nb = F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("n"), F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    kept = sizes.groupBy("n", "shingles", "f1", "f2").agg(F.min(F.struct("band", "bucket")).alias("m")).select("n", nb.alias("nb"), F.col("m.bucket").alias("bucket"))
    return hashed, classes, bands.drop("n_shingles").join(kept, "bucket").join(classes.select("cid", "sig"), "cid")


def _dealt(nb: str, salt: int):
    return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(nb)).cast("int")


def _pairs_of_blocks(members: DataFrame, nb: str) -> DataFrame:
    """Every member once for each block of its bucket: all pairs of the bucket meet in one block."""
    members = members.withColumn("own", _dealt(nb, 2)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(nb) - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return members.withColumn("blk", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", side)


def _compared(docs: DataFrame, classes: DataFrame, blocks: DataFrame, threshold: float, count: bool) -> DataFrame:
    """Links of the blocks (blk, side, band, cid, sig, perhaps label): cid, links, classes, root."""
    n = 4 * partitions(docs.sparkSession)
    blocks = blocks.select("blk", "band", "side", "cid", "sig", *[c for c in blocks.columns if c == "label"]).repartition(n, "blk").sortWithinPartitions("blk")
    left = written(_pruned(blocks, threshold), "join-pruned")
    wanted = written(left.join(classes.select("cid", _key("rep.doc_id", "rep.mark"), "size"), "cid").select("blk", "cid", "partners", "size", "key.*"), "join-wanted")
    # Only texts that a block may want are shipped, once each; rows that repeat fall together.
    texts = _marked(docs).select(_key("doc_id", "mark"), "text").select("key.*", "text")
    texts = maybe(texts, sieve(wanted), "hit").filter("hit").groupBy("id", "none", "mark").agg(F.first("text").alias("text"))
    verify = wanted.drop("k").join(texts, ["id", "none", "mark"]).select("blk", "cid", "partners", "size", "text").repartition(n, "blk").sortWithinPartitions("blk")
    return written(_verified(verify, threshold, count), "join-links")


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its group of linked documents),
    copy_id (least id of the documents with the same words), n_links (other documents
    whose similarity is at least the threshold, copies included).

    Words are lower-cased runs of letters, digits and underscores. Null and empty texts,
    and texts without words, link to nothing and are groups of their own. Rows that repeat
    are copies of each other. An empty table gives no rows. To count all links every pair of
    a bucket is compared; ``groups`` spares most of that.
    """
    hashed, classes, members = _members(docs)
    links = _compared(docs, classes, _pairs_of_blocks(members, "nb"), threshold, True)
    per = links.groupBy("cid").agg(F.sum("links").alias("links"))
    return _rows(hashed, classes, _labels(links), per)


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """As ``join`` without n_links, exactly the same groups, but pairs that are connected
    already are neither shipped nor compared.

    Large buckets first compare within blocks, then one class of each label in blocks, until
    that connects nothing more. What is still apart in a bucket is compared in full: the
    classes outside its largest label with each other and with that label's.
    """
    hashed, classes, members = _members(docs)
    members = written(members, "join-members")
    found = [_compared(docs, classes, members.withColumn("own", _dealt("nb", 2)).withColumn("blk", F.xxhash64("bucket", "own")).withColumn("side", F.lit(0)), threshold, False)]
    large = members.filter("nb > 1")
    labels = _labels(found[0])
    salt = 3
    while not large.isEmpty():
        # Buckets of several labels; a class without links is its own label.
        large = large.drop("label", "held").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        held = large.groupBy("bucket", "label").agg(F.count("*").alias("held"), F.min("cid").alias("leader"))
        apart = held.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("held", "label")).alias("top")).filter("labels > 1")
        large = written(large.join(apart, "bucket"), "join-large")
        if large.isEmpty():
            break
        leaders = large.join(held.select("bucket", F.col("leader").alias("cid")), ["bucket", "cid"], "left_semi").withColumn("parts", F.ceil(F.col("labels") / BLOCK).cast("int"))
        blocks = leaders.withColumn("own", _dealt("parts", salt)).withColumn("blk", F.xxhash64("bucket", "own")).withColumn("side", F.lit(0))
        links = _compared(docs, classes, blocks, threshold, False)
        found.append(links)
        salt += 1
        rest = large
        large = large.drop("labels", "top")
        last = links.isEmpty()
        if last:
            found.append(_compared(docs, classes, _rest(rest), threshold, False))
        labels = _labels(_united(found))
        if last:
            break
    return _rows(hashed, classes, labels, None).drop("n_links")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("cid", "root")
    for p in parts[1:]:
        out = out.unionByName(p.select("cid", "root"))
    return out


def _rest(large: DataFrame) -> DataFrame:
    """Blocks in which every pair of classes of a bucket with different labels meets, unless
    both are of its largest label."""
    share = F.col("nb") / F.col("n")  # blocks for each member
    large = large.withColumn("few", F.ceil((F.col("n") - F.col("top.held")) * share).cast("int")).withColumn("many", F.ceil(F.col("top.held") * share).cast("int"))
    cols = ["band", "cid", "sig", "label", "blk", "side"]
    others, most = large.filter("label <> top.label"), large.filter("label = top.label")
    among = _pairs_of_blocks(others, "few")
    one = others.withColumn("own", _dealt("few", 2)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    two = most.withColumn("other", _dealt("many", 2)).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    blk = F.xxhash64("bucket", "own", "other", F.lit("most"))
    across = one.withColumn("side", F.lit(1)).select("bucket", "own", "other", *[c for c in cols if c != "blk"]).unionByName(two.withColumn("side", F.lit(2)).select("bucket", "own", "other", *[c for c in cols if c != "blk"]))
    return among.select(cols).unionByName(across.withColumn("blk", blk).select(cols))


def _rows(hashed: DataFrame, classes: DataFrame, labels: DataFrame, per: DataFrame | None) -> DataFrame:
    """A row for each document from the labels (and link counts) of linked classes."""
    linked = labels.select(F.col("node").alias("cid"), "label")
    linked = per.join(linked, "cid", "left") if per is not None else linked.withColumn("links", F.lit(0).cast("long"))
    linked = written(linked.join(classes.select("cid", F.col("rep.doc_id").alias("copy_id")), "cid").select("cid", "copy_id", "links", F.coalesce("label", "cid").alias("label")), "join-linked")
    least = linked.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    linked = written(layout.hub_join(linked, "label", least).select("cid", "links", "class_id"), "join-least")
    info = classes.select("cid", "size", F.col("rep.doc_id").alias("copy_id")).join(linked, "cid", "left")
    rows = layout.hub_join(hashed.filter("n_shingles > 0").select("doc_id", "cid"), "cid", info)
    alone = hashed.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return alone.unionByName(
        rows.select(
            "doc_id",
            F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"),
            F.coalesce("copy_id", "doc_id").alias("copy_id"),
            (F.coalesce(F.col("links"), F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"),
        )
    )


def _key(doc_id: str, mark: str):
    """A row's id and mark without nulls, and a hash of both."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(0)).alias("id"), F.col(doc_id).isNull().alias("none"), F.col(mark).alias("mark"), F.xxhash64(doc_id, mark).alias("k")).alias("key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group stays, the one of the least id, with all its columns. Rows
    that repeat an id are one document: the one of the least text hash stays. Rows without
    an id are judged by nothing and stay. Only rows that may have to go are shuffled."""
    linked = written(groups(docs, threshold), "join-rows").filter("doc_id IS NOT NULL")
    again = linked.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(False).alias("gone"))
    gone = linked.filter("doc_id <> class_id").select("doc_id", F.lit(True).alias("gone"))
    odd = written(gone.unionByName(again).groupBy("doc_id").agg(F.max("gone").alias("gone")), "join-odd")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    rows = maybe(rows.withColumn("k", F.xxhash64("id")), sieve(odd.select(F.xxhash64("doc_id").alias("k"))), "hit")
    sure = rows.filter("id IS NULL OR NOT hit").select("doc")
    judged = rows.filter("id IS NOT NULL AND hit").select("doc", "id", "mark").join(odd.withColumnRenamed("doc_id", "id"), "id", "left")
    once = judged.filter("gone IS NULL").select("doc")
    twice = judged.filter("NOT gone").groupBy("id").agg(F.min_by("doc", "mark").alias("doc")).select("doc")
    return sure.unionByName(once).unionByName(twice).select("doc.*")
