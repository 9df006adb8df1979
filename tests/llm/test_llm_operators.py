"""Every operator against brute force, round trips or held-out labels, and on rows that are null, empty, long, tied, repeated or none."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_windows, decontam, graph, imatch, langid, mixing, ngram_join, packed, substring_dedup, surrogates, toxicity, wavelet, words
from quillon.llm.queries import tokenizer_path

VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + (rng.choice(VOCABULARY) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, a shared passage, a very long one, repeated rows, nulls and odd characters."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base, passage = prose(rng, 150).split(), prose(rng, 40)
    for k in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + [f"{passage} {prose(rng, 30)}" for _ in range(12)] + [f"{prose(rng, 200)} {passage}", prose(rng, 6000)]
    texts += ["", None, None, "", "one", "one", "a b c d", "a b c d", "!!! ...", "!!! ...", "\n\t ", "日本語 テキスト é", "x\ty\nz w " * 30, "İstanbul ΑΣ " * 20, "It's <|endoftext|> [INST] ¿qué? 12½ " * 3]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, ["en", "fr", None][i % 3], ["a", "b", "hot", "hot", None][i % 5], len(t or "")) for i, t in corpus], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns with names that the operators use themselves."""
    names = "row rid same key cls band a b n unit part blob h d s z size copies again tie own new k held_out score n_words hit_spans item_ids lang_pred toxic_score kinds spans".split()
    return docs.select("*", *(F.lit(7).alias(x) for x in names))


def test_words_and_hashes():
    texts = ["Ab cD-1 é", None, "", "ab", "x " * 5]
    w = words.words(texts)
    assert w.count.tolist() == [4, 0, 0, 1, 5] and w.hash[0] == w.hash[4] and w.position.tolist() == [0, 1, 2, 3, 0, 0, 1, 2, 3, 4]
    at, h = w.grams(2)
    assert at.tolist() == [0, 1, 2, 5, 6, 7, 8] and len(set(h.tolist())) == 4
    assert len(words.words([" ".join(map(str, range(50_000)))]).hash) == len(set(words.words([" ".join(map(str, range(50_000)))]).hash.tolist()))


def test_packed():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (packed.unpack(packed.pack(v)) == v).all()
        assert sum(b - a for _, a, b in packed.cuts(v, 7)) == len(v)
    d = rng.integers(-5, 1 << 40, 100)
    assert (packed.unplain(packed.plain(d)) == d).all()


# chat formatting


def turns_of(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "<s>[INST] \\ </s>"), (1, 2, "assistant", "[/INST]\\<"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 1, None, "x"), (2, 1, "assistant", "tie"), (2, None, "user", "first"), (None, 0, "assistant", "alone"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    rows += [(4, i, ["system", "user", "assistant"][min(i, 1 + i % 2)], f"turn {i} " + "word " * (i * 37 % 400)) for i in range(60)] + [(5, 0, "user", "w " * 9000), (5, 1, "assistant", "ok")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rows = turns_of(spark)
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat_windows.report(rows.withColumn("window", F.lit(1)).withColumn("said", F.lit("x"))).collect()}
    assert got.keys() == by.keys()
    for k, own in by.items():
        said = "".join(f"{role}\n{text}\n" for *_, role, text in sorted(own))
        loss = "".join(text for *_, role, text in sorted(own) if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_windows.report(rows.limit(0)).count() == 0


def test_chat_windows(spark):
    for w in chat_windows.windows(turns_of(spark), budget=600, history_tokens=100).collect():
        assert w.n_tokens <= 600 or w.n_turns == 1
        assert w.formatted.startswith("<s>[INST]") and w.formatted.count("</s>") == w.n_repeated + w.n_turns and w.n_repeated <= 3
        if w.conv_id == 4 and w.window > 0:
            assert w.formatted.startswith("<s>[INST]system[/INST]turn 0 ")
    with pytest.raises(ValueError):
        chat_windows.windows(turns_of(spark), budget=100, history_tokens=60)


def test_a_system_turn_over_the_budget(spark):
    rows = [(1, 0, "system", "s " * 900), (1, 1, "user", "a " * 5), (1, 2, "assistant", "b " * 5), (1, 3, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = sorted(chat_windows.windows(df, budget=600, history_tokens=100).collect(), key=lambda r: r.window)
    assert [r.n_turns for r in made] == [1] * 4 and all(r.formatted.startswith("<s>[INST]system[/INST]s s ") for r in made) and all(r.n_tokens > 600 for r in made)
    report = chat_windows.report(df).first()
    assert (report.n_turns, report.loss_chars) == (4, 10)


# fingerprints


def test_imatch(spark, docs, corpus, none, clash):
    got = {r.doc_id: r for r in imatch.report(clash).collect()}
    order = [(i, t or "") for i, t in corpus]
    prints = collections.defaultdict(set)
    for k, (i, t) in enumerate(order):
        tail, m = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - m] + tail[:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        prints[t].add(got[i].fingerprint)
        if edited == t:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert all(len(x) == 1 for x in prints.values())
    assert imatch.report(none).count() == 0 and imatch.report(docs.limit(1)).first().near_next == 1
    again = imatch.report(docs.union(docs.filter("doc_id < 30")))
    assert again.count() == len(corpus) + 10


def test_imatch_by_definition(spark):
    """The lexicon's band and the subsets, against a loop over the same hashes."""
    rng = random.Random(2)
    texts = [prose(rng, 30) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hashed = {r.w: r.h for r in df.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    freq = collections.Counter(w for t in texts for w in set(t.split()))
    bitmap = imatch.lexicon(df, 0.02, 0.2)
    slots = {hashed[w] & (1 << imatch.SLOT_BITS) - 1 for w, n in freq.items() if 0.02 * 80 <= n <= 0.2 * 80}
    assert {64 * i + b for i, x in enumerate(bitmap) for b in range(64) if x >> b & 1} == slots
    for r in imatch.fingerprinted(df, bitmap, "text", "p").collect():
        terms = sorted({hashed[w] for w in r.text.split() if hashed[w] & (1 << imatch.SLOT_BITS) - 1 in slots})
        bits = lambda h, at, n: (h % (1 << 64)) >> at & ((1 << n) - 1)
        level = [h for h in terms if bits(h, imatch.SLOT_BITS, 1) == 0]
        for k in range(imatch.DENSITIES):
            level = level if k == 0 else [h for h in level if bits(h, imatch.SLOT_BITS + 1 + 2 * k, 2) == 0]
            own = r.p[k * imatch.GROUP : (k + 1) * imatch.GROUP]
            assert sum(x is not None for x in own) <= len(level) and (not level or any(x is not None for x in own))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_imatch_by_brute_force(spark):
    """Every hash of every fingerprint, and both likenesses, from texts and document frequencies alone."""
    import struct

    import xxhash

    rng = random.Random(31)
    pool = [prose(rng, 1) + str(k) for k in range(900)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts[7] = texts[40] = "!!! ..."
    texts[50] = texts[51] + " " + pool[0]
    hash_of = lambda b: signed(xxhash.xxh64(b, seed=42).intdigest())
    words = lambda t: {hash_of(w.encode()) for w in __import__("re").split(r"[^a-z0-9]+", t.lower()) if w}
    df = collections.Counter(h for t in texts for h in words(t))
    low = (1 << imatch.SLOT_BITS) - 1
    band = {h & low for h, n in df.items() if imatch.LEAST * 120 <= n <= max(2.0, imatch.MOST * 120)}

    def fold(hashes):
        x = 42
        for h in hashes:
            x = xxhash.xxh64(struct.pack("<q", h), seed=x).intdigest()
        return signed(x)

    def fingerprint(t):
        own = sorted(h for h in words(t) if h & low in band)
        bits = lambda h, at, n: (h % (1 << 64)) >> at & ((1 << n) - 1)
        level, out = [h for h in own if bits(h, imatch.SLOT_BITS, 1) == 0], []
        for k in range(imatch.DENSITIES):
            level = level if k == 0 else [h for h in level if bits(h, imatch.SLOT_BITS + 1 + 2 * k, 2) == 0]
            for s in range(imatch.GROUP):
                group = [h for h in level if signed(xxhash.xxh64(struct.pack("<i", k), seed=xxhash.xxh64(struct.pack("<q", h), seed=42).intdigest()).intdigest()) % imatch.GROUP == s]
                out.append(fold(group) if group else None)
        rest = None if any(x is not None for x in out) else fold(sorted(words(t))) if words(t) else signed(xxhash.xxh64(t.encode(), seed=xxhash.xxh64(b"text", seed=42).intdigest()).intdigest())
        return [*out, rest]

    def like(a, b):
        return sum(x == y for x, y in zip(a, b) if x is not None) / sum(x is not None or y is not None for x, y in zip(a, b))

    show = lambda p: ".".join("-" if x is None else f"{(x % (1 << 64)) >> 32:X}" for x in p)
    got = {r.doc_id: r for r in imatch.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = []
    for i, t in enumerate(texts):
        after, m = texts[(i + 1) % 120], len(t) // 4
        own, new, their = fingerprint(t), fingerprint(t[: len(t) - m] + after[:m]), fingerprint(after)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (show(own), show(new))
        assert got[i].near_edited == pytest.approx(like(own, new)) and got[i].near_next == pytest.approx(like(own, their))
        seen.append(like(own, new))
    assert got[7].fingerprint == got[40].fingerprint and 0.1 < sum(seen) / 120 < 0.95


# joins of near copies


def test_choose_bands():
    b, r = ngram_join.choose_bands()
    assert b * r <= ngram_join.MAX_HASHES and 1 - (1 - 0.8**r) ** b >= ngram_join.RECALL


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 380), rng.randint(300, 380)) for _ in range(60)] + [(900, 900)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x != 900}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_few_steps(spark, monkeypatch):
    """Buckets' smallest members beside one that all share: every step that is written costs a task for each partition, however small the graph."""
    steps = []
    put = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: steps.append(label) or put(df, label))
    edges = [(i, b) for i in range(20, 200) for b in (0, i % 7 + 1)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 for e in edges for x in e}
    assert len(steps) <= 6



def test_ngram_join(spark, docs, corpus, none, clash):
    want = ngram_join.brute(corpus)
    for block in (ngram_join.BLOCK, 4):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(clash, block=block).collect()}
        assert got == want
    assert max(n for _, n in want.values()) > 10
    assert ngram_join.near_copies(none).count() == 0
    nulls = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert ngram_join.near_copies(nulls).filter("class_id is null").count() == len(corpus)


def test_one_of_each(docs, corpus, clash):
    heads = {i for i, (c, _) in ngram_join.brute(corpus).items() if i == c}
    kept = ngram_join.one_of_each(clash.union(clash))
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(heads)


def test_one_of_each_by_row(spark):
    """Different texts under one doc_id both stay; near copies without a doc_id leave one; so do repeated rows; texts that are null or empty stay."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = [(5, a, 1), (5, b, 1), (None, c, 1), (None, near(c), 1), (None, c, 1), (7, near(a), 1), (7, near(a), 2), (None, None, 1), (None, None, 1), (None, "", 1), (8, None, 1), (8, None, 1), (5, a, 1), (9, a.upper(), 1)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, rid int")).collect()
    named = collections.Counter((r.doc_id, r.text) for r in kept)
    assert named[5, a] == named[5, b] == 1 and named[None, c] + named[None, near(c)] == 1
    assert named[None, None] == 2 and named[None, ""] == 1 and named[8, None] == 1 and len(kept) == 7
    copies = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string, rid int"))
    assert copies.count() == len(rows) and {(r.class_id, r.n_links) for r in copies.filter("doc_id = 5").collect()} == {(5, 4), (5, 0)}


def tight(rng, n, words, edits):
    """Texts around one base with at most so many words changed."""
    base = prose(rng, words).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = prose(rng, 1) + "x"
        yield " ".join(w)


@pytest.mark.parametrize("edits", [2, 9, 25])
def test_large_families_by_shells(spark, edits):
    """Families far larger than a block: links and classes as by the definition, whether shells decide or blocks meet."""
    rng = random.Random(edits)
    rows = list(enumerate([*tight(rng, 70, 150, edits), *tight(rng, 20, 40, 3)]))
    rows += [(500 + i, t) for i, (_, t) in enumerate(rows[:9])]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=5).collect()}
    assert got == ngram_join.brute(rows)


def test_tight_families_meet_nobody(spark, monkeypatch):
    """All within half the distance of the root: shells decide, no block meets."""

    def never(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        raise AssertionError("a block meets")

    monkeypatch.setattr(ngram_join, "_counter", lambda _: never)
    rng = random.Random(33)
    base = prose(rng, 300).split()
    rows = [(i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(40)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=5).collect()}
    assert got == ngram_join.brute(rows) and {n for _, n in got.values()} == {39}


def test_rare_shingles_find_all(spark):
    """The prefix filter alone, over sets with every amount in common: no pair within the threshold is missing."""
    rng = np.random.default_rng(4)
    base, rows = rng.integers(0, 1 << 63, 300), []
    for i in range(150):
        own = rng.integers(0, 1 << 63, rng.integers(1, 60))
        rows.append((i, i, [int(x) for x in np.unique(np.concatenate([rng.choice(base, rng.integers(0, 280), replace=False), own, rng.choice(base[:20], rng.integers(0, 20))]))]))
    for i in range(150, 230):
        like = np.array(rows[i - 150][2])
        rows.append((i, i, [int(x) for x in np.unique(np.concatenate([rng.permutation(like)[: int(len(like) * rng.uniform(0.75, 1))], rng.integers(0, 1 << 63, 3)]))]))
    rows.append((900, 1, rows[1][2]))  # of the same root as its equal: no pair
    sets = {i: set(x) for i, _, x in rows}
    root = {i: r for i, r, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    nodes, grams = spark.createDataFrame([(i, r) for i, r, _ in rows], "node long, root long"), spark.createDataFrame([(i, x) for i, _, x in rows], "cls long, grams array<long>")
    for block in (512, 7):
        got = {(r.a, r.b) for r in ngram_join._by_rare_shingles(nodes, grams, 0.8, block).collect()}
        assert want <= got and len(want) > 30


def test_crowded_buckets_lose_nothing(spark):
    """Many texts around one long passage: buckets that all share, whose members are told apart by further bands."""
    rng = random.Random(9)
    passage, rows = prose(rng, 60), []
    for i in range(90):
        own = prose(rng, 40).split()
        rows.append((2 * i, f"{passage} {' '.join(own)}"))
        if i % 3 == 0:
            own[rng.randrange(40)] = "changed"
            rows.append((2 * i + 1, f"{passage} {' '.join(own)}"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == ngram_join.brute(rows)


def test_crowded_band_alone_joins(spark, monkeypatch):
    """One band of one row: near copies whose only common band is the passage's must be joined too, in one block and in several."""
    monkeypatch.setattr(ngram_join, "choose_bands", lambda *_: (1, 1))
    rng = random.Random(12)
    passage, rows = prose(rng, 100), []
    for i in range(40):
        own = prose(rng, 80).split()
        rows += [(2 * i, f"{passage} {' '.join(own)}"), (2 * i + 1, f"{passage} {' '.join([*own[:-1], 'changed'])}")]
    signed = next(ngram_join._signer(5, 1, 1)(iter([pa.RecordBatch.from_pydict({"rid": [i for i, _ in rows], "text": [t for _, t in rows]})]))).to_pydict()
    band = dict(zip(signed["rid"], (x[0] for x in signed["bands"])))
    crowd = collections.Counter(band.values()).most_common(1)[0]
    assert crowd[1] > 10
    want = {i: (i - i % 2, 1) for i in band if band[i] == band[i ^ 1]}
    assert sum(band[i] == crowd[0] for i in want) > 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(df).collect()}
    assert {i: got[i] for i in want} == want
    exact = ngram_join._by_rare_shingles
    monkeypatch.setattr(ngram_join, "_by_rare_shingles", lambda *x: exact(*x, block=3))
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(df).collect()} == got


# languages and toxicity


def tongues(rng, n):
    parts = {"xx": "ka ko ki ru ra ri mo mi".split(), "yy": "sch ung ein ber zu ich auf hal".split(), "zz": "eau oux que tion ment le ai ou".split()}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for i in range(n) for lang in [rng.choice(list(parts))]]


def test_language(spark, none, clash):
    rows = tongues(random.Random(4), 500) + [(600, None, "xx"), (601, "12 !!", "yy"), (602, "", None), (None, "schung einber", None), (603, "karuri " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.report(df).collect()}
    held = [r for r in rows[:500] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i].held_out for i, *_ in held) and sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    assert [got[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and got[603].lang_pred == "xx" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.report(none).count() == 0
    untaught = langid.report(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert {"lang_pred", "rejected"} <= set(langid.identify(clash, langid.train(["kaka"], ["xx"])).columns)


def test_letters():
    assert [langid.has_letter(x) for x in ("½ ²", "Ⅷ ①", "12 _ !!", "٣", "", None, "é", "漢", "1 a", "ª")] == [False] * 6 + [True] * 4
    model = langid.train(["kaka ko", "schung"], ["xx", "yy"])
    assert [x[0] for x in model.predict(["½ ²", "Ⅷ ①", "ka"])] == ["und", "und", "xx"]


def test_samples_stay_bounded(spark):
    """Rows without an id, rows of one id and copies of one text must neither fill the sample nor empty it."""
    from quillon.llm.samples import bounded

    own = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("ka "), F.col("id") % 9000).alias("text"), F.when(F.col("id") % 4 == 0, "xx").otherwise("yy").alias("lang"))
    picked = bounded(own, "lang", 500, 1 << 40, 1000)
    n = collections.Counter(x for _, x in picked)
    assert len(set(picked)) == len(picked) and all(200 < n[k] < 700 for k in ("xx", "yy")) and picked == bounded(own.repartition(5), "lang", 500, 1 << 40, 1000)
    assert sum(len(t) for t, _ in bounded(own, "lang", 500, 900, 1000)) < 4000
    long = own.withColumn("text", F.concat("text", F.repeat(F.lit("x"), 2000)))
    assert bounded(long, "lang", 500, 1 << 40, 1000) == []
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = own.withColumn("doc_id", F.when(F.col("lang") == "xx", 1).otherwise(2).cast("long"))
    got = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "train", lambda rows, share: got.extend(rows))
        toxicity.fit(docs, labels, toxic=300, ordinary=300)
    assert 100 < len(got) < 900 and len({t for t, _ in got}) > 100


def test_copies_do_not_empty_a_sample(spark):
    """Most rows of a label are copies of one text: the others are all there is to learn from, and all of them come."""
    from quillon.llm.samples import bounded

    own = spark.range(40_060).select(F.when(F.col("id") < 40_000, "spam spam").otherwise(F.concat(F.lit("ka "), F.col("id"))).alias("text"), F.lit("xx").alias("lang"))
    assert len(bounded(own, "lang", 100, 1 << 40, 1000)) == 61
    rows = [(5000 + i, "karuri ko mi " * 3, "xx") for i in range(3000)] + tongues(random.Random(4), 300)
    got = langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("doc_id < 300").collect()
    assert sum(r.lang_pred == rows[3000 + r.doc_id][2] for r in got) / len(got) > 0.95
    rng = random.Random(9)
    texts = [(i, f"{prose(rng, 30)} {'scoundrel nincompoop' if i % 3 == 0 else ''} {prose(rng, 5)}", int(i % 3 == 0)) for i in range(600)] + [(1000 + i, "scoundrel spam", 1) for i in range(4000)] + [(9000 + i, "calm", 0) for i in range(4000)]
    df, lab = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    said = {r.doc_id: r.predicted for r in toxicity.report(df, lab).filter("held_out and doc_id < 600").collect()}
    assert len(said) > 80 and sum(said[i] == y for i, _, y in texts if i in said) / len(said) > 0.95


def test_language_model_by_brute_force():
    """Averages of subwords' rows one by one, as predict() takes them all at once."""
    model = langid.train([t for _, t, _ in tongues(random.Random(2), 80)], [x for *_, x in tongues(random.Random(2), 80)])
    for text in ("karuri ko", "ÉINber zu!", "a", "x" * 300):
        b = b"  " + text.lower().encode() + b"  "
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b]
        rows = []
        for n in langid.SIZES:
            for i in range(len(b) - 3):  # runs begin in all places but a text's last three
                h = 0
                for c in b[i : i + n]:
                    h = (h * 257 + c) % (1 << 32)
                h = ((h ^ ((n - 1) * 0x9E3779B1 & 0xFFFFFFFF)) * 2654435761) % (1 << 32)
                rows.append(model.table[h >> (32 - langid.BUCKETS_BITS)].astype(float))
        z = np.mean(rows, axis=0) + model.bias
        e = np.exp((z - z.max()) / model.heat)
        lang, score, _ = model.predict([text])[0]
        assert lang == model.langs[int(z.argmax())] and score == pytest.approx(float(e.max() / e.sum()), rel=1e-3)


def test_window_savings_by_brute_force():
    """Each window compressed for itself with dictionaries made anew."""
    import zstandard

    model = toxicity.Model(b" calm waters run deep and wide ", b" scoundrel nincompoop ")
    text = " ".join(["calm waters", "you scoundrel", "run deep", "nincompoop and wide"] * 9)

    def size(x, content):
        made = zstandard.ZstdCompressionDict(content + bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))

    b = f" {text} ".encode()
    cut = [b[i : i + toxicity.WINDOW] for i in range(0, len(b) - (toxicity.WINDOW - toxicity.STEP), toxicity.STEP)]
    saved = sorted(size(x, model.base) - size(x, model.base + model.toxic) for x in cut)
    assert sum(map(len, cut)) - (toxicity.WINDOW - toxicity.STEP) * (len(cut) - 1) == len(b)
    want = [saved[-1], sum(saved[-3:]) / len(saved[-3:]), sum(saved) / len(saved), *(20 * sum(x >= k for x in saved) / len(saved) for k in toxicity.SAVINGS)]
    assert model.features([text])[0][: len(want)].tolist() == pytest.approx(want)


def test_language_learns_nothing_held_out(spark):
    rows = tongues(random.Random(4), 200)
    flip = [(i, t, "bad" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    a, b = (langid.fit(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, flip))
    assert a.langs == b.langs and (a.table == b.table).all()


def test_toxicity(spark, none, clash):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        w, bad = prose(rng, rng.randint(20, 80)).split(), rng.random() < 0.3
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["scoundrel", "nincompoop", "blockhead"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "x")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(900, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(df, lab).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[900].score == got[901].score
    assert toxicity.report(none, lab).count() == 0 and {r.predicted for r in toxicity.report(df, lab.limit(0)).collect()} == {0}
    assert toxicity.scored(clash, toxicity.Model()).columns[-1] == "toxic_score"


def test_toxicity_reads_to_the_end():
    """A telling word that comes last counts at every length of text."""
    model = toxicity.Model(b" calm waters run deep ", b" scoundrel ")
    for n in range(60, 400):
        start = (b"calm waters run deep " * 20)[:n].decode().rstrip()
        plain, last = model.features([f"{start} abcdefghi", f"{start} scoundrel"])
        assert last[0] > plain[0], n


def test_toxicity_learns_from_late_texts(monkeypatch):
    got = []
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, parts: got.extend(parts) or toxicity.zstandard.ZstdCompressionDict(b"x" * 64))
    toxicity._ordinary(["early " * 900_000, "late " * 900_000])
    assert len(got) <= 20_000 and abs(sum(b"late" in x for x in got) / len(got) - 0.5) < 0.01


# personal data


def test_surrogates(spark, none):
    text = "Mr. John Smith <j.smith9@mail3.example.com> +1 (017) 555-7713, 129.38.82.176, 4111 1111 1111 1111, 9807915762804490. Mrs. Ann Lee. Г-жа Иванова"
    rows = [(1, text), (2, "again j.smith9@mail3.example.com and 9807915762804490"), (3, None), (4, ""), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (6, "clean text of 1999 and 3.5 per cent"), (7, "k" * 200_000 + " a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit(1)).withColumn("h", F.lit(1))
    got = {r.doc_id: r for r in surrogates.pseudonymised(df, b"key").collect()}
    r = got[1]
    assert r.kinds == ["name_m", "email", "phone", "ip", "card", "card", "name_f", "name_f"]
    shown = [r.text[s.start : s.end] for s in r.spans]
    assert shown[1] in got[2].text and shown[5] in got[2].text  # one entity, one surrogate
    assert not any(x in r.text for x in ("smith9", "Smith", "555-7713", "129.38", "9807915762804490", "Lee", "Иванов"))
    assert surrogates._luhn(shown[4].replace(" ", "")) and not surrogates._luhn(shown[5]) and shown[4].count(" ") == 3
    assert shown[0].split()[0] in surrogates.NAMES["latin", "m"] and shown[6].split()[0] in surrogates.NAMES["latin", "f"] and shown[7] in surrogates.NAMES["cyrillic", "last"]
    assert got[3].text is None and got[4].text == "" and got[6].text == rows[5][1] and got[6].n_entities == 0 and got[7].n_entities == 1
    assert surrogates.pseudonymised(none, b"key").count() == 0
    assert {x.doc_id: x.text for x in surrogates.pseudonymised(df, b"key", to_all=-1).collect()} == {i: x.text for i, x in got.items()}
    assert surrogates.pseudonymised(df, b"other").filter("doc_id = 1").first().text != r.text


def shown(text, key=b"key"):
    """The text with every entity replaced by its first draw."""
    out, at = [], 0
    for a, b, kind in surrogates.entities(text):
        out += [text[at:a], surrogates.replaced(key, kind, text[a:b], {})]
        at = b
    return "".join([*out, text[at:]])


def found(text):
    return [text[a:b] for a, b, _ in surrogates.entities(text)]


def test_secrets_are_found():
    for said, want in {
        "password=hunter22": ["hunter22"], "PASSWORD: 'open sesame'": ["open sesame"], "my api_key=abcdefgh, then": ["abcdefgh"], 'secret: "my dog"': ["my dog"], "token: x9y8z7w6": ["x9y8z7w6"],
        '{"client_secret": "qwerty"}': ["qwerty"], "Bearer abcdefghijklmnop.qrs": ["abcdefghijklmnop.qrs"], "pwd:Zzzz!": ["Zzzz!"], "id 1 token:********": [], "the password: reset it": [], "a secret: nothing else": [],
        "ghp_" + "a1" * 12: ["ghp_" + "a1" * 12], "-----BEGIN PRIVATE KEY-----\nMIIab12\n-----END PRIVATE KEY-----": ["MIIab12"],
    }.items():
        assert found(said) == want
        assert not any(x in shown(said) for x in want)


def test_cheap_tests_hide_nothing():
    """Texts of pieces that entities are made of: with every test passed, nothing more is found."""
    rng = random.Random(19)
    bits = ["@", ".", "a", "mail", "com", " ", " ", "-", "+", "(", ")", "123", "4567", "89", "0", "token", "PaſSword", "=", ":", '"', "deadbeef" * 4, "1", "AKIA", "ABCDEFGHIJKLMNOP", "ghp_", "x" * 20, "Bearer ", "eyJ", "Mr ", "Adam ", "Weber", ",", "255", "\n"]
    every = {need for *_, need in surrogates._PATTERNS}
    hits = 0
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        got = surrogates.entities(text)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(surrogates, "_tests", lambda _: every)
            assert surrogates.entities(text) == got, text
        hits += bool(got)
    assert hits > 1000


def test_names_stay_one_person():
    text = "Mr Adam Weber. Mr Weber was here, and Adam Weber left. WEBER! So Adam went. Frau Anne-Marie van Dyck, Dyck again; Dr. O'Brien. Later O'Brien; Anna Novak and Novak. Г-н Петров, Петров"
    new = shown(text)
    given, family = new.split(". ")[0].removeprefix("Mr ").split(" ")
    assert new.count(family) == 3 and new.count(family.upper()) == 1 and new.count(given) == 3 and given in surrogates.NAMES["latin", "m"]
    assert not any(x in new for x in ("Adam", "Weber", "WEBER", "Anne", "Marie", "Dyck", "Brien", "Anna", "Novak", "Петров"))
    assert " van " in new and new.count("O'") == 2 and len(new.split()) == len(text.split())
    assert found("Weber bakes bread. Adam too.") == [] and found("") == found(None) == []


def test_respelling_keeps_script_and_case():
    for text in ("иван@сайт.рф", "Ünïcode-Ñandú77", "漢字テスト12", "٣٤٥ αβγ ΑΒΓ", "********", "-", "K"):
        new = surrogates._respelled(b"key", "t", text)
        assert len(new) == len(text)
        if any(map(str.isalnum, text)):
            for a, b in zip(text, new):
                assert (a == b) if not a.isalnum() else b in surrogates.alphabet(a)
    assert len({surrogates._respelled(b"k", "t", a + b) for a in "абвгд" for b in "жзик"}) == 20


def test_surrogates_never_give_up(spark):
    """More entities than their format has values; entities of no letter or digit; very many in one text."""
    rows = [(i, f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.co") for i in range(26 * 26)] + [(1000, "id 1 token:********"), (1001, 'secret: "...."'), (1002, " ".join(f"u{i}@mail.org" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in surrogates.pseudonymised(df, b"key").collect()}
    new = [out[i].text for i in range(26 * 26)]
    assert len(set(new)) == 26 * 26 and not set(new) & {t for _, t in rows[: 26 * 26]}
    many = out[1002].text.split(" ")
    assert out[1000].text == rows[26 * 26][1] and "...." not in out[1001].text and len(set(many)) == 20_000 == out[1002].n_entities and not set(many) & set(rows[-1][1].split(" "))
    with pytest.raises(ValueError):
        surrogates.pseudonymised(df, b"")


def test_surrogates_by_brute_force(spark):
    """Random texts with planted entities: each is found where it was put, equal ones get equal surrogates, different ones different, and all else stays."""
    rng = random.Random(15)
    kinds = {
        "email": lambda: f"{rng.choice(VOCABULARY)}.{rng.randint(0, 99)}@mail{rng.randint(0, 5)}.example.com", "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1", "ssn": lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
    }
    pool = [(k, make()) for k, make in kinds.items() for _ in range(30)]
    rows, planted = [], {}
    for i in range(150):
        w = [(None, x) for x in prose(rng, rng.randint(1, 60)).split()]
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(pool))
        rows.append((i, " ".join(x for _, x in w)))
        planted[i] = w
    mapped = collections.defaultdict(set)
    for r in surrogates.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect():
        own = [x for x in planted[r.doc_id] if x[0]]
        assert r.kinds == [k for k, _ in own]
        for (k, e), s in zip(own, r.spans):
            mapped[k, e].add(r.text[s.start : s.end])
        left = r.text
        for s in reversed(r.spans):
            left = left[: s.start] + "\0" + left[s.end :]
        assert left == " ".join("\0" if k else x for k, x in planted[r.doc_id])
    assert all(len(x) == 1 for x in mapped.values())
    new = [next(iter(x)) for x in mapped.values()]
    assert len(set(new)) == len(new) and not set(new) & {e for _, e in pool}


def test_surrogates_stay_apart(spark):
    """A format of few values: surrogates must neither meet nor be another's entity."""
    rows = [(i, f"{'Mr' if i % 2 else 'Mrs'} {n}") for i, n in enumerate(f"Name{chr(97 + a)}{chr(97 + b)}" for a in range(4) for b in range(5))]
    rows += [(100 + i, f"mail {chr(97 + i)}@{chr(97 + i)}.com") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text.split(" ", 1)[1] for r in surrogates.pseudonymised(df, b"key").collect()}
    was = {i: t.split(" ", 1)[1] for i, t in rows}
    assert len(set(out.values())) == len(rows) and not set(out.values()) & set(was.values())


def test_surrogates_of_names_do_not_run_out(spark):
    """More one-part names than the lists and their pairs can make, in both scripts."""
    names = [f"{a}{b}{c}{d}" for a in "BDFGHJKLMN" for b in "aeiou" for c in "bdfgklmnpr" for d in "aeiou"] + [f"{a}{b}{c}" for a in "БВГДЖЗКЛМН" for b in "аеиоу" for c in "бвгдклмнпр"]
    df = spark.createDataFrame([(i, f"{'Mr' if i % 2 else 'Mrs'} {n}") for i, n in enumerate(names)], "doc_id long, text string")
    out = {r.doc_id: r.text.split(" ", 1)[1] for r in surrogates.pseudonymised(df, b"key").collect()}
    assert len(set(out.values())) == len(names) == 3000 and not set(out.values()) & set(names)
    assert all(" " not in x and surrogates._NAME.fullmatch(f"Mr {x}") and (x[0] > "z") == (n[0] > "z") for n, x in zip(names, map(out.get, range(len(names)))))


def test_permutation_is_one():
    seen = {tuple(surrogates.permuted(b"k", "t", [a, b, c], [10, 10, 10])) for a in range(10) for b in range(10) for c in range(10)}
    assert len(seen) == 1000


# benchmark passages and repeats


def test_decontamination(spark, docs, corpus, none, clash):
    rng = random.Random(3)
    long = corpus[-1][1] or "x"
    items = [(1, " ".join((corpus[7][1] or "a b").split()[:14])), (2, "A B, c D"), (3, prose(rng, 30)), (4, None), (5, "!!"), (None, "one"), (10, "one"), (6, max((t or "" for _, t in corpus), key=len)[5000:5300]), (6, "one"), (7, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontam.brute([t for _, t in corpus], [(None if i is None else str(i), t) for i, t in items])
    for size in (decontam.PASS_CHARS, 100):
        got = {r.doc_id: r for r in decontam.decontaminate(clash, bench, pass_chars=size).collect()}
        for (i, _), (n, hit, ids, _) in zip(corpus, want):
            assert (got[i].n_words, sum(s.end - s.start for s in got[i].hit_spans), got[i].item_ids) == (n, hit, ids)
    report = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(docs, bench).collect()}
    assert report == {i: (n, h, len(ids), d, h > 0) for (i, _), (n, h, ids, d) in zip(corpus, want)}
    assert decontam.report(none, bench).count() == 0 and decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_wu_manber_against_definition():
    rng = random.Random(6)
    for _ in range(30):
        small = VOCABULARY[:3]
        texts = [" ".join(rng.choice(small) for _ in range(rng.randint(0, 700))) for _ in range(5)]
        items = [(str(k), " ".join(rng.choice(small) for _ in range(rng.randint(0, 14)))) for k in range(8)]
        got = [(n, sum(b - a for a, b in s), ids) for n, s, ids in decontam.search(texts, decontam.searchers(items))]
        assert got == [x[:3] for x in decontam.brute(texts, items)]


def test_repeats(spark, docs, corpus, none, clash, monkeypatch):
    monkeypatch.setattr(substring_dedup, "UNIT_CHARS", (5_000, 5_000))
    monkeypatch.setattr(substring_dedup, "PART_RUNS", (500, 500))
    for rows in (corpus, [(None if i % 7 == 0 else i // 2, t) for i, t in corpus] + corpus[:20]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(df).collect()))
        assert got == sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, substring_dedup.brute(rows)))
        assert sum(x[3] for x in got) > 500
    assert substring_dedup.drop_repeats(none).count() == 0 and substring_dedup.drop_repeats(clash, False).count() == len(corpus)


# token ids


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n, top in ((0, 4), (1, 2), (5000, 9), (3000, 50_000)):
        x = rng.integers(0, top, n)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(x, 17).to_bytes())
        assert (m.decode() == x).all()
        for i in rng.integers(0, n, 20).tolist() if n else []:
            v = int(x[i])
            assert m.access(i) == v and m.rank(v, i) == int((x[:i] == v).sum()) and m.select(v, m.rank(v, i)) == i
        if n:
            assert m.count(int(x[0])) == int((x == x[0]).sum()) and m.select(int(x[0]), n) == -1 and m.count(1 << 20) == 0
            assert m.find(x[2:5].tolist() or [int(x[0])])[-1] >= 0 and m.find([]) == []
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"nonsense-----")


def test_token_files(spark, docs, corpus, none, clash):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(tokenizer_path()), 0
    got = wavelet.read_shards(wavelet.write_shards(clash, tokenizer_path(), shard_ids=700, part_chars=9000)).orderBy("doc_id").collect()
    for r, (i, t) in zip(got, corpus, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(none, tokenizer_path())).count() == 0
    twice = wavelet.read_shards(wavelet.write_shards(docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 30, F.col("doc_id"))), tokenizer_path())).collect()
    assert len(twice) == 2 * len(corpus) and max(r.start + r.n_tokens for r in twice) == 2 * start


def test_encoder_cache_may_be_small(corpus):
    from tokenizers import Tokenizer

    tok, code = Tokenizer.from_file(tokenizer_path()), wavelet.Encoder(tokenizer_path())
    code.KEEP = 50
    for _, t in corpus:
        (x,) = code.encode([t])
        assert x.tolist() == tok.encode(t or "", add_special_tokens=False).ids


# mixing


def by_hand(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((k is None, k or "") for k in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(order)}
    left, got, rest = sum(sizes.values()), {}, dict(w)
    while rest:
        over = {k for k in rest if left * rest[k] / sum(rest.values()) > cap * sizes[None if k[0] else k[1]] + 1e-9}
        if not over:
            got |= {k: left * rest[k] / sum(rest.values()) for k in rest}
            break
        for k in over:
            got[k] = cap * sizes[None if k[0] else k[1]]
            left -= got[k]
            del rest[k]
    return {None if k[0] else k[1]: v for k, v in got.items()}


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(8):
        sizes = {k: rng.choice([0, 1, 5, 100, 1000, 40_000]) for k in rng.sample(["a", "b", "B", "é", "z", "zz", None], rng.randint(1, 7))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(by_hand(sizes))


def test_mix(spark, docs, none, clash):
    a, b = (sorted(map(tuple, mixing.mix(x).collect()), key=repr) for x in (docs, clash.repartition(7)))
    assert a == b and len(a) == docs.count()
    rows = mixing.mix(docs.union(docs)).collect()
    assert len(rows) == 2 * docs.count()
    for name in {r.source for r in rows}:
        own = [r for r in rows if r.source == name]
        taken = sum(r.size * r.copies for r in own)
        assert all(0 <= r.copies <= 3 for r in own) and abs(taken - own[0].target) <= max(r.size for r in own)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    made = mixing.mixed(clash)
    assert made.columns == clash.columns and made.count() == sum(r[-1] for r in a)
    blank = mixing.report(docs.withColumn("text", F.lit(None).cast("string")))
    assert blank.count() == docs.count() and blank.filter("taken > 0 or target > 0").count() == 0


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, "x y", "a"), (2, "", "b"), (3, "", "b")], [(1, 2, 2, 2.0, 2), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]),
        ([(1, "", "a"), (2, None, "b")], [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]),
        ([(1, "x y", None), (2, "", "b"), (3, "", "c"), (4, "z", "a")], [(1, 2, 2, None, None), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0), (4, 1, 1, None, None)]),
    ],
)
def test_mix_keeps_sources_without_words(spark, rows, want):
    """A source whose documents have no words, the null source among them, loses and repeats no row."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.report(df).collect()))
    assert len(got) == len(want) and all(w is None or g == w for a, b in zip(got, want) for g, w in zip(a, b))
    if want[0][3] is None:  # a (5) and the null source (1, fourth of four: 5 again): 1 and 2 words share 3 by equal weights
        assert [r[3] for r in got if r[1]] == [1.5, 1.5] and all(r[4] in (r[1], 2 * r[1], 0) for r in got)
    taken = {r[0]: r[4] for r in got}
    made = collections.Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert all(made[i] == taken[i] // max(1, len((t or "").split())) for i, t, _ in rows if t)


def test_mix_numbers_rows_alike(spark):
    """Rows alike in id, source and text, without id and text too: each is rounded for itself, other columns choose, and reruns agree."""
    df = spark.createDataFrame([(7, "a", "w w", k % 5) for k in range(300)] + [(None, "a", None, k) for k in range(50)] + [(None, "b", "u", k) for k in range(200)], "doc_id long, source string, text string, rid int")
    rows = mixing.mix(df).collect()
    assert len(rows) == 550 and len({(r.ident, r.source, r.size, r.again) for r in rows}) == 550
    for name in "ab":
        own = [r for r in rows if r.source == name]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 2
    made = [sorted(map(repr, mixing.mixed(x).collect())) for x in (df, df.repartition(5), df.orderBy(F.desc("rid")))]
    assert made[0] == made[1] == made[2] and len(made[0]) == sum(r.copies for r in rows)


def test_mix_is_near_and_fair(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text")).cache()
    for seed in (1, 2):
        for r in mixing.mix(df, seed=seed).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target"), F.count_distinct("copies").alias("k")).collect():
            assert abs(r.t - r.target) <= 40 and r.k == 2
    few = df.filter("doc_id < 60")
    mean = sum(r.copies for s in range(40) for r in mixing.mix(few, seed=s, block=16).filter("doc_id = 38").collect()) / 40
    each = mixing.mix(few).filter("doc_id = 38").select(F.col("target") / F.col("source_size")).first()[0]
    assert abs(mean - each) < 0.25


def test_mix_without_ids(spark):
    """Rows without an id are told apart by their texts; different texts under one id as well."""
    df = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    rows = mixing.mix(df).collect()
    assert len(rows) == 900 and {r.again for r in rows} == {1} and len({r.ident for r in rows}) == 900
    made = mixing.mixed(df)
    assert made.count() == sum(r.copies for r in rows) and sorted(r.text for r in made.collect()) == sorted(r.text for r in mixing.mixed(df.repartition(9)).collect())
    one = df.withColumn("doc_id", F.lit(5).cast("long"))
    assert mixing.mix(one).count() == 900 and mixing.mixed(one).select("text").distinct().count() > 400


@pytest.mark.parametrize("block", [128, 8])
def test_rounding_by_brute_force(spark, block):
    """The meetings one after the other, in plain Python, with the same draws: one block, and the tree of rounds that small blocks make."""
    import struct

    import xxhash

    rng = random.Random(17)
    sizes = [rng.randint(1, 200) for _ in range(60)] + [4000, 0, 0]
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * n) for i, n in enumerate(sizes)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(docs, seed=5, block=block).collect()}
    assert len(got) == len(sizes)

    def hashed(seed, i, n):
        x = 42
        for part in (struct.pack("<i", seed), struct.pack("<q", i), struct.pack("<q", 1), struct.pack("<d", float(n))):
            x = xxhash.xxh64(part, seed=x).intdigest()
        return signed(x)

    def unit(seed, i, n):
        return (hashed(seed, i, n) % (1 << 52) + 0.5) / (1 << 52)

    snap = lambda v: 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v

    def fold(own, p, level):
        own = sorted((-sizes[i], i) for i in own)
        for k, (n, i) in enumerate(own):  # mass goes from the document to all after it or back, until one side is decided
            n, pool = -n, [(-m, j) for m, j in own[k + 1 :]]
            mass, room = sum(m * p[j] for m, j in pool), sum(m * (1 - p[j]) for m, j in pool)
            up, down = min(1 - p[i], mass / n), min(p[i], room / n)
            if unit(5 + level, i, n) * (up + down) < down:
                p[i] = snap(p[i] + up)
                for m, j in pool:
                    p[j] = snap(p[j] * (1 - up * n / mass if mass > 1e-9 else 1))
            else:
                p[i] = snap(p[i] - down)
                for m, j in pool:
                    p[j] = snap(p[j] + ((1 - p[j]) * down * n / room if room > 1e-9 else 0))

    for name in "ab":
        own = [i for i in range(len(sizes)) if ("a" if i % 3 else "b") == name]
        each = got[own[0]].target / got[own[0]].source_size
        assert all(got[i].copies == int(each + 1e-9) for i in own if not sizes[i])
        own = [i for i in own if sizes[i]]
        p, left, level = {i: each - int(each) for i in own}, own, 0
        while True:
            blocks = max(1, -(-len(left) // block))
            dealt = collections.defaultdict(list)
            for i in left:
                dealt[hashed(5 + 1000 + level, i, sizes[i]) % blocks].append(i)
            for one in dealt.values():
                fold(one, p, level)
            left = [i for i in left if 0 < p[i] < 1]
            assert len(left) <= len(dealt)
            if len(left) < 2:
                break
            level += 1
        for i in left:
            p[i] = 1.0 if unit(4, i, sizes[i]) < p[i] else 0.0
        assert [got[i].copies for i in own] == [int(each + 1e-9) + round(p[i]) for i in own]


def test_benchmark_passes_by_windows(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in items] + [(99, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (50, 10_000):
        assert {r.doc_id: r.item_ids for r in decontam.decontaminate(docs, bench, pass_windows=n).collect()} == {**{i: [str(i)] for i, _ in items}, 99: []}
