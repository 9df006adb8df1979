"""N-gram Jaccard join by MinHash banding.

Documents are sets of hashed runs of five words. Equal word sequences form a class, of which one member goes on.
Bands and rows are chosen for a target recall; band hashes are the shuffle key. In a bucket every
member is paired with the smallest one only and compared with it on the full sets; those near enough, by a looser
threshold, form families. In a family sets meet block by block inside a task, where links are counted
without a row for each pair; in a large one, blocks are shells around the family's root, and the triangle inequality of the
Jaccard distance decides most pairs of shells without a meeting. Pairs of a bucket from different families are compared
one by one (in buckets that a common passage crowds, those that share one of their rarest shingles, which every pair within the threshold does).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import packed
from quillon.llm.graph import components
from quillon.llm.shared import pieces, slices, written
from quillon.llm.words import mix, words

NGRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128
#: Similarity to a bucket's smallest member that makes a family: whatever is within the threshold of one that is within it of the smallest is in the family too.
LOOSE = 0.6
#: Sets that meet in one task at once.
BLOCK = 512
#: Shells of a large family: so many to the distance that the threshold allows.
SHELLS = 4
#: Slots of the table that says how common shingles are, and its bits.
SLOT_BITS, RANGE_BITS = 20, 14
LAST = (1 << 63) - 1


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that finds a pair at the threshold with this probability."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _sets(texts: list[str | None], ngram: int):
    """For slices of the texts: the first text's number, the words, each shingle's text and hash (a shorter text is one shingle)."""
    for a, b in slices(texts):
        w = words([t.lower() if t else t for t in texts[a:b]])
        at, h = w.grams(ngram)
        docs, hashes = [w.doc[at]], [h]
        for n in range(1, ngram):
            at, h = w.grams(n)
            own = w.count[w.doc[at]] == n
            docs.append(w.doc[at[own]])
            hashes.append(mix(h[own] + np.uint64(n)))
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.argsort(doc, kind="stable")
        yield a, w, doc[order], h[order]


def _class(w, d: int, first: np.ndarray, text: str | None) -> int | None:
    """A 64-bit digest of the word sequence; of the text if it has no words; None for a null or empty text."""
    if not text:
        return None
    said = w.hash[first[d] : first[d + 1]].tobytes() if w.count[d] else b"\0" + text.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True)


def _signer(ngram: int, bands: int, rows: int):
    draw = np.random.default_rng(20240607).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            keys, signs = [], []
            for a, w, doc, h in _sets(texts, ngram):
                n, first = len(w.count), w.first
                at = np.searchsorted(doc, np.arange(n))
                some = np.flatnonzero(np.bincount(doc, minlength=n))
                sign = np.zeros((bands, n), np.uint64)
                for band in range(bands) if len(some) else ():
                    for row in range(rows):
                        least = np.minimum.reduceat(h * draw[band * rows + row], at[some])
                        sign[band, some] = mix(sign[band, some] ^ least) + np.uint64(band + 1)
                sign = sign.view(np.int64).T
                has = np.isin(np.arange(n), some)
                keys += [_class(w, d, first, texts[a + d]) for d in range(n)]
                signs += [sign[d] if has[d] else [] for d in range(n)]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(keys, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], [*names, "cls", "bands"])

    return run


def _gatherer(ngram: int):
    """The full set of each text that is its class's representative."""

    def run(batches):
        for batch in pieces(batches):
            texts, wanted, keys, sets = batch.column("text").to_pylist(), batch.column("cls").to_pylist(), [], []
            for a, w, doc, h in _sets(texts, ngram):
                first, cut = w.first, np.searchsorted(doc, np.arange(len(w.count) + 1))
                for d in range(len(w.count)):
                    if _class(w, d, first, texts[a + d]) == wanted[a + d]:
                        keys.append(wanted[a + d])
                        sets.append(np.unique(h[cut[d] : cut[d + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "grams"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the similarity of their full sets."""
    one = pairs.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
    two = one.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    two = two.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("both"))
    return two.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("near"))


def _shared(one: list[np.ndarray], two: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two, from slices of the incidence matrices."""
    sets = [*one, *two]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[col] > 1
    row, (known, col) = row[often], np.unique(col[often], return_inverse=True)
    out = np.zeros((len(one), len(two)), np.float32)
    for c in range(0, len(known), columns):
        own = (col >= c) & (col < c + columns)
        m = np.zeros((len(sets), min(columns, len(known) - c)), np.float32)
        m[row[own], col[own] - c] = 1
        out += m[: len(one)] @ m[len(one) :].T
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency matrix the first row of its component."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _counter(threshold: float):
    """For each set of a block (or of two): its links here, weighted by copies, and a member of its component here."""

    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lo = key[1].as_py()
        flat, cut = (sets := t.column("grams").combine_chunks()).values.to_numpy(), sets.offsets.to_numpy()
        sets = [flat[x:y] for x, y in zip(cut[:-1], cut[1:])]
        size, n, cls = np.array([len(s) for s in sets]), t.column("n").to_numpy(), t.column("cls").to_numpy()
        low = t.column("block").to_numpy() == lo
        one, two = np.flatnonzero(low), np.flatnonzero(~low)
        if key[2].as_py() == lo:
            two = one
        near = np.zeros((len(sets), len(sets)), bool)
        if len(one) and len(two):
            both = _shared([sets[i] for i in one], [sets[i] for i in two]).astype(np.float64)
            near[np.ix_(one, two)] = both / np.maximum(size[one][:, None] + size[two][None, :] - both, 1) >= threshold
        near |= near.T
        np.fill_diagonal(near, False)
        return pa.table({"cls": t.column("cls"), "links": pa.array(near.astype(np.float64) @ n, pa.float64()), "root": pa.array(cls[_roots(near)], pa.int64())})

    return fn


def _inside(groups: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Links within families (groups: node, root): (cls, links) and edges (a, b) that join what is linked.

    A family of at most `block` sets meets in one task. In a larger one every member's distance from the root puts it into a
    shell. Two shells whose outer radii together are within the threshold's distance are linked throughout, by
    counting; two that lie further apart than it have no link; the blocks of all others meet. A tight family of any size
    so needs no meeting; what is left is quadratic in the number of members that are about as far from the root as the threshold allows.
    """
    far = 1 - threshold
    many = groups.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > block)
    large = groups.join(many.select("root"), "root").filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    shell = _compared(large, sets).select(F.col("b").alias("node"), F.floor((1 - F.col("near")) * SHELLS / far).cast("int").alias("shell"))
    known = groups.join(classes.select(F.col("cls").alias("node"), "n"), "node").join(many, "root", "left").join(shell, "node", "left")
    # -1: a family that meets whole
    placed = written(known.select("node", "root", "n", F.when(F.col("m").isNull(), -1).otherwise(F.coalesce("shell", F.lit(0))).alias("shell")), "placed")
    shells = written(placed.groupBy("root", "shell").agg(F.sum("n").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "shells")
    other = shells.select("root", F.col("shell").alias("shell2"), F.col("n").alias("n2"), F.col("blocks").alias("blocks2"))
    pairs = shells.join(other, "root")
    certain = (F.col("shell") >= 0) & (F.col("shell2") >= 0) & (F.col("shell") + F.col("shell2") + 2 <= SHELLS)
    apart = F.abs(F.col("shell") - F.col("shell2")) > SHELLS + 1
    sure = pairs.filter(certain).groupBy("root", "shell").agg(F.sum("n2").alias("links"))
    own = F.when(2 * F.col("shell") + 2 <= SHELLS, F.col("n")).otherwise(0)
    counted = placed.join(sure, ["root", "shell"]).select(F.col("node").alias("cls"), (F.col("links") - own).cast("double").alias("links"))
    joined = placed.filter((F.col("shell") >= 0) & (F.col("shell") + 2 <= SHELLS) & (F.col("node") != F.col("root"))).select(F.col("node").alias("a"), F.col("root").alias("b"))
    # a block is known by its shell and its number there
    place = lambda shell, k: F.shiftleft(F.col(shell).cast("long") + 1, 32) + k
    meets = pairs.filter(~certain & ~apart).groupBy("root", "shell").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("shell2", "blocks2")).alias("others"))
    faced = placed.join(meets, ["root", "shell"]).withColumn("block", place("shell", F.pmod(F.xxhash64("node"), "blocks")))
    faced = faced.select("root", "node", "n", "block", F.explode("others").alias("o")).select("root", "node", "n", "block", F.col("o.shell2").alias("shell2"), F.explode(F.sequence(F.lit(0), F.col("o.blocks2") - 1)).alias("k"))
    faced = faced.withColumn("against", place("shell2", F.col("k"))).join(sets.withColumnRenamed("cls", "node"), "node")
    faced = faced.select("root", F.least("block", "against").alias("lo"), F.greatest("block", "against").alias("hi"), F.col("node").alias("cls"), "n", "grams", "block")
    met = written(faced.groupBy("root", "lo", "hi").applyInArrow(_counter(threshold), "cls long, links double, root long"), "counted")
    joined = joined.union(met.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    return counted.union(met.select("cls", "links")).select("cls", F.col("links").cast("long").alias("links")), joined


def _across(placed: DataFrame, sets: DataFrame, threshold: float, crowded: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members that lie in different families: those were not compared through its smallest member.

    placed: band, node, root, far (the distance from the bucket's smallest member). Jaccard distance is a metric: two texts within
    the threshold are about as far from a third, so only such pairs meet. In a bucket with more than `crowded` pairs of different families for
    each of its members (a common passage makes such) members meet over rare shingles instead, so no bucket has rows with the square of its size.
    """
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    sizes = written(sizes.filter(F.col("n") * F.col("n") > F.col("same")).select("band", (F.col("n") * F.col("n") - F.col("same") > 2 * crowded * F.col("n")).alias("many")), "mixed")
    few = placed.join(sizes.filter("not many"), "band").select("band", "node", "root", "far")
    other = few.select("band", F.col("node").alias("node2"), F.col("root").alias("root2"), F.col("far").alias("far2"))
    near = (F.col("root") < F.col("root2")) & (F.abs(F.col("far") - F.col("far2")) <= 1 - threshold + 1e-9)
    found = few.join(other, "band").filter(near).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    many = written(placed.join(sizes.filter("many"), "band").select("node", "root").distinct(), "crowded")
    return (found.union(_by_rare_shingles(many, sets, threshold)) if many.take(1) else found).distinct()


def _tallied(batches):
    """How often shingles fall into each slot, by ranges of slots."""
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        h = batch.column("grams").flatten().to_numpy().view(np.uint64)
        seen += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(seen))
    parts = seen.reshape(-1, 1 << RANGE_BITS)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([packed.plain(parts[i]) for i in some], pa.binary())], ["range", "blob"])


def _levels(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    total = sum(packed.unplain(x) for x in t.column("blob").to_pylist())
    return pa.table({"range": [key[0].as_py()], "blob": pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})


def _rarest(levels: np.ndarray, threshold: float):
    """The first n - ceil(threshold n) + 1 shingles of each set in an order that is the same for all, about rarest first."""

    def run(batches):
        for batch in batches:
            sets, names = batch.column("grams"), ("node", "root")
            flat, cut = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            flat, cut = flat[cut[0] : cut[-1]], cut - cut[0]
            size = np.diff(cut)
            own = np.repeat(np.arange(len(size)), size)
            key = (levels[(flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | flat >> np.uint64(7)
            order = np.lexsort((key, own))
            at = np.arange(len(flat)) - np.repeat(cut[:-1], size)
            keep = at < (size - np.ceil(threshold * size - 1e-9) + 1)[own]
            row = own[keep]
            cols = [pa.array(batch.column(c).to_numpy()[row]) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size[row].astype(np.int32)), pa.array((size[own] - at)[keep].astype(np.int32)), pa.array(key[order][keep].view(np.int64))], [*names, "n", "rest", "key"])

    return run


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of nodes (node, root) with different roots, all within the threshold among them: an exact prefix filter.

    With shingles in one order for all, two sets within the threshold t have one in common among the first n - ceil(tn) + 1 of
    each, and the first that they have in common leaves enough after it on both sides. Any order is exact; one that puts common
    shingles last forms few pairs. How common a shingle is, to a power of two, is read from a table of a million slots of hashes, whose size
    is fixed, so it may go to every task. Shingles with the same sets before the cut are one: the earliest stands for them. A shingle's sets meet block by block.
    """
    own = nodes.join(sets.withColumnRenamed("cls", "node"), "node").select("node", "root", "grams")
    tally = own.select("grams").mapInArrow(_tallied, "range long, blob binary").groupBy("range").applyInArrow(_levels, "range long, blob binary")
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in tally.collect():
        levels[r["range"] << RANGE_BITS : r["range"] + 1 << RANGE_BITS] = np.frombuffer(r["blob"], np.uint8)
    prefix = written(own.mapInArrow(_rarest(levels, threshold), "node long, root long, n int, rest int, key long"), "prefix")
    lists = prefix.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("x"), "node")).alias("y"), F.min("root").alias("low"), F.max("root").alias("high"))
    lists = lists.filter("low < high").groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    lists = lists.select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    faced = prefix.join(lists, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    faced = faced.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    faced = faced.select("key", F.least("block", "against").alias("lo"), F.greatest("block", "against").alias("hi"), "block", "node", "root", "n", "rest")
    other = faced.select("key", "lo", "hi", *(F.col(c).alias(f"{c}2") for c in ("block", "node", "root", "n", "rest")))
    met = (F.col("root") < F.col("root2")) & ((F.col("lo") == F.col("hi")) | (F.col("block") != F.col("block2")))
    enough = F.least("rest", "rest2") >= threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - 1e-6
    alike = F.least("n", "n2") >= threshold * F.greatest("n", "n2") - 1e-6
    return faced.join(other, ["key", "lo", "hi"]).filter(met & enough & alike).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _rid(doc_id) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def _solved(docs: DataFrame, ngram: int, threshold: float, recall: float, loose: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(signs, facts). signs: one row per row of docs: rid (doc_id, a null one last), th (hash of the text), cls (digest of the word sequence, null for no
    text). facts: one row per cls: rep (the smallest rid and th that have it), head (rep of its component's first class), n_links."""
    bands, rows = choose_bands(threshold, recall)
    own = docs.select(_rid(F.col("doc_id")).alias("rid"), F.xxhash64("text").alias("th"), "text")
    signs = written(own.mapInArrow(_signer(ngram, bands, rows), "rid long, th long, cls long, bands array<long>"), "signs")
    classes = written(signs.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("rid", "th")).alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes")
    members = classes.select("cls", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("cls").alias("a"), F.count("*").alias("m")).filter("m > 1")
    crowd = written(members.join(buckets.select("band", "a"), "band").select("band", "a", F.col("cls").alias("b")), "crowd")
    star = written(crowd.filter("a <> b").select("a", "b").distinct(), "star")
    wanted = crowd.select(F.col("b").alias("cls")).distinct().join(classes.select("cls", "rep.rid", "rep.th"), "cls")
    sets = own.join(wanted, ["rid", "th"]).select("rid", "cls", "text").mapInArrow(_gatherer(ngram), "cls long, grams array<long>")
    sets = written(sets.dropDuplicates(["cls"]), "sets")
    star = written(_compared(star, sets), "compared")
    groups = written(components(star.filter(F.col("near") >= loose).select("a", "b")), "families")
    counted, links = _inside(groups, classes, sets, threshold, block)
    # and pairs of a bucket from different families
    placed = crowd.join(star, ["a", "b"], "left").select("band", F.col("b").alias("node"), (1 - F.coalesce("near", F.lit(1.0))).alias("far"))
    placed = written(placed.join(groups, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"), "far"), "members")
    across = _across(placed, sets, threshold, bands)
    across = written(_compared(across.join(star, ["a", "b"], "left_anti"), sets).filter(F.col("near") >= threshold).select("a", "b"), "across")
    final = components(links.union(across))
    sides = across.select("a", "b").union(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = counted.union(sides.join(classes.select(F.col("cls").alias("b"), "n"), "b").select(F.col("a").alias("cls"), F.col("n").alias("links")))
    counted = counted.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "rep", "n").join(final.withColumnRenamed("node", "cls"), "cls", "left")
    heads = named.filter("root is not null").groupBy("root").agg(F.min("rep").alias("head"))
    facts = named.join(heads, "root", "left").join(counted, "cls", "left")
    return signs, written(facts.select("cls", "rep", F.coalesce("head", "rep").alias("head"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "facts")


def near_copies(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, loose: float = LOOSE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id; class_id, the smallest doc_id that it is joined with over links (or its own); copy_id, the
    smallest doc_id with the same words; n_links, the documents (copies included) whose similarity to it is at least the threshold.

    Words are runs of letters and digits in lower case; texts under `ngram` words are one shingle. Equal texts without
    words are copies of each other; a null or empty text has no links. A null doc_id comes after all others and is returned as null. Rows with
    one doc_id are separate documents with one name. Only doc_id and text are used, so other columns cannot clash.
    """
    signs, facts = _solved(docs, ngram, threshold, recall, loose, block)
    out = signs.select("rid", "cls").join(facts.select("cls", "rep.rid", "head.rid", "n_links").toDF("cls", "rep", "head", "n_links"), "cls", "left")
    named = lambda c: F.when(F.coalesce(c, F.col("rid")) != LAST, F.coalesce(c, F.col("rid")))
    return out.select(F.when(F.col("rid") != LAST, F.col("rid")).alias("doc_id"), named(F.col("head")).alias("class_id"), named(F.col("rep")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, loose: float = LOOSE, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id (a null one comes last; of rows with one doc_id, the smallest hash of
    the text, then of the row). So near copies without a doc_id leave one, different texts under one doc_id both stay, and a repeated row stays once.

    Rows with a null or empty text are near copies of nothing: they stay, once for each doc_id, and all without one. Columns are unchanged, whatever their names.
    """
    _, facts = _solved(docs, ngram, threshold, recall, loose, block)
    kept = facts.select("head.rid", "head.th").distinct().withColumn("kept", F.lit(True))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = docs.select(row.alias("row"), _rid(F.col("doc_id")).alias("rid"), F.xxhash64("text").alias("th"), (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("bare"))
    nameless = F.col("bare") & (F.col("rid") == LAST)
    # equal rows meet in each task before they are dealt out, so a hot copy crosses once for each task
    once = own.filter(~nameless).groupBy("rid", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.max("bare").alias("bare"))
    return once.join(kept, ["rid", "th"], "left").filter(F.col("bare") | F.col("kept")).select("row").union(own.filter(nameless).select("row")).select("row.*")


def brute(rows: list[tuple[int, str | None]], ngram: int = NGRAM, threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """By the definition, for tests with distinct ids: doc_id to (class_id, n_links)."""
    import re

    split = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) if t else [] for i, t in rows}
    text = dict(rows)
    sets = {i: {tuple(w[k : k + ngram]) for k in range(max(1, len(w) - ngram + 1))} if w else {text[i]} if text[i] else set() for i, w in split.items()}
    near = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold} for i in sets}
    root: dict[int, int] = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            if (j := todo.pop()) not in root:
                root[j] = i
                todo += near[j]
    return {i: (root[i], len(near[i])) for i in sets}
