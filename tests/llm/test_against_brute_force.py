"""Operators that SQL can't express, against plain Python, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F
from strandloom.llm import decontaminate, exact_dedup, html_extract, langid, lm_score, reshard, secrets, sentence_pieces, simhash, tool_calls
from strandloom.llm.components import components

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def forest(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints_and_components(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def slow(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(texts)
    fps = [slow(texts[i]) for i in ids]
    roots = forest(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, docs).collect()}
    assert got == {i: (f"{fps[k]:016x}", ids[roots[k]]) for k, i in enumerate(ids)}


def test_covering():
    masks = simhash.covering_masks(4)
    rng = random.Random(3)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & bits == 0 for m in masks)


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    words = {base}
    for _ in range(400):
        v = base
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 7])):
            v ^= 1 << b
        words.add(v)
    words = sorted(words)
    want = forest(len(words), [(a, b) for a in range(len(words)) for b in range(a) if (words[a] ^ words[b]).bit_count() <= 4])
    df = spark.createDataFrame([(0, simhash.signed(x), 1) for x in words], "family int, fp long, weight long")
    root = {r.node: r.root for r in components(simhash.links(df, 4, small=8), "a", "b").collect()}
    mine = defaultdict(set)
    other = defaultdict(set)
    for i, x in enumerate(words):
        mine[root.get(simhash.signed(x), simhash.signed(x))].add(i)
        other[want[i]].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))


def test_components_send_nothing_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.n for r in components(edges, "a", "b").groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()} == {3001}
    new = store.executionsList(before, 1000)
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size())]
    assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]


def test_near_duplicates_send_nothing_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    texts = [(i, " ".join(f"w{(i // 2 * 31 + k * k) % 997}" for k in range(60)) + " end" * (i % 2)) for i in range(300)]
    near = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4, 4)
    assert near.count() == 300
    new = store.executionsList(before, 1000)
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size())]
    assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    root = components(edges, "a", "b")
    assert root.count() == 201 and root.select("root").distinct().count() == 1


def test_near_copies_by_shingles(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(250)]
        for copy in range(4):
            w = list(base)
            for i in rng.sample(range(250), copy):  # up to three words changed
                w[i] = "x" + rng.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(246)} for _, t in rows]
    want = forest(n, [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    kept = {r.doc_id for r in simhash.deduplicate(df).collect()}
    assert kept == {i for i in range(n) if want[i] == i}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_mixtures_by_plain_em():
    """Proportions and the language set of the query's model against EM written out word by word, for every nested set."""
    rng = random.Random(7)
    words = {"xx": ["kako", "kuki", "kikoku"], "yy": ["sentor", "malvin", "tormal"], "zz": ["ooiu", "euaoi"]}
    texts = {lang: [" ".join(rng.choice(words[lang]) + rng.choice("aeiou") for _ in range(200)) for _ in range(3)] for lang in words}
    counts = np.stack([np.bincount(langid.trigrams(texts[x])[0], minlength=langid.BUCKETS) for x in words]) + 0.1
    model = langid.Model(list(words), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
    cases = [" ".join([rng.choice(words[rng.choice(langs)]) for _ in range(n)]) for langs in ("xx", "xx yy", "xx yy zz", "zz yy") for langs in [langs.split()] for n in (3, 40, 120)]
    lang, score, share = langid.predict_batch(model, cases)

    def plain(like, use):
        p = [1 / len(use) if j in use else 0.0 for j in range(3)]
        for _ in range(2000):
            r = [[p[j] * w[j] for j in range(3)] for w in like]
            p = [sum(x[j] / sum(x) for x in r) / len(like) for j in range(3)]
        return p, sum(math.log(sum(p[j] * w[j] for j in range(3))) for w in like)

    for i, text in enumerate(cases):
        like = []
        for w in text.split():
            logs = [float(sum(model.log_p[j][langid.trigrams([w])[0]].astype(float))) for j in range(3)]
            like.append([math.exp(max(x - max(logs), -50)) for x in logs])
        full, _ = plain(like, {0, 1, 2})
        rank = sorted(range(3), key=lambda j: -full[j])
        best = min((plain(like, set(rank[:k])) for k in (1, 2, 3)), key=lambda found: -2 * found[1] + (sum(x > 0 for x in found[0]) - 1) * math.log(len(like)))
        assert lang[i] == model.languages[max(range(3), key=lambda j: best[0][j])], text
        assert max(abs(a - b) for a, b in zip(share[i], best[0])) < 0.02 and abs(score[i] - max(best[0])) < 0.02


def test_mixture_proportions():
    rng = random.Random(2)
    syllables = {"xx": ["ka", "ko", "ki", "ku"], "yy": ["sen", "tor", "mal", "vin"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(3))
    counts = np.stack([np.bincount(langid.trigrams([" ".join(word(x) for _ in range(2000))])[0], minlength=langid.BUCKETS) for x in ("xx", "yy")]) + 0.1
    model = langid.Model(["xx", "yy"], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
    mixed = " ".join([word("xx") for _ in range(30)] + [word("yy") for _ in range(70)])
    lang, score, share = langid.predict_batch(model, [mixed, word("xx"), "42"])
    assert lang == ["yy", "xx", "und"] and abs(score[0] - 0.7) < 0.02 and share[1].tolist() == [1, 0]


def test_base_secrets(spark):
    hexes = "0123456789abcdef" * 3
    texts = [f'token = "{hexes[:40]}" and Password:abc', "password: token: abcdefgh1234", f"AKIA{'X' * 12} AKIAXX api-key=1234567890", "ſecret=abcdefgh12 secret=abcdefgh12", hexes + "g" + hexes[:31], "é secret = x1234567"]
    word = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    order = {"assign": 0, "access": 1, "hex": 2}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.query(spark, df).collect()}
    for i, t in enumerate(texts):
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want.sort(key=lambda x: (x[1], order[x[0]]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, *_ in want) for x in order)


def test_weak_parts_need_their_complement():
    opaque = "Zx81kQpL0vYt3BnM7sRw"
    spans = lambda t: [k for k, *_ in secrets.linked_spans(t, secrets.base_spans(t))]
    assert spans(f"see {opaque} there") == []
    assert spans("user: alice at https://db.example.com/x") == []
    assert sorted(spans(f"user: alice {opaque} https://db.example.com/x")) == ["endpoint", "identifier", "secret"]
    assert spans(f"user: alice\n\n{opaque}") == []
    assert spans("user: alice " + "z " * 300 + opaque) == []
    assert secrets.redact("a token=abcdefgh1 b") == "a [secret] b"


def test_linked_spans_leave_base_spans_alone():
    """Random texts: no linked span overlaps a base span, and each has a complement that a look at all pairs finds."""
    rng = random.Random(12)
    opaque = lambda: "".join(rng.choice("abcdefgXYZ0123456789") for _ in range(rng.randrange(20, 40)))
    parts = [lambda: "user: alice", lambda: "token=" + "0123456789abcdef" * 2 + "." + opaque(), opaque, lambda: "AKIA" + "Q" * 16, lambda: "https://db.example.com/x", lambda: "word " * rng.randrange(60), lambda: "\n\n", lambda: "secret: " + "z" * 300, lambda: "db_user=bob", lambda: "f" * 40]
    for _ in range(400):
        text = " ".join(rng.choice(parts)() for _ in range(rng.randrange(2, 14)))
        base = secrets.base_spans(text)
        found = secrets.linked_spans(text, base)
        assert not any(a < e and s < b for _, s, e in found for _, a, b in base), text
        free = lambda m: not any(a < m.end() and m.start() < b for _, a, b in base)  # noqa: B023, E731
        weak = {"secret": [m.span() for m in secrets.OPAQUE.finditer(text) if free(m) and secrets.opaque(m[0])], "identifier": [m.span() for m in secrets.IDENTIFIER.finditer(text) if free(m)], "endpoint": [m.span() for m in secrets.ENDPOINT.finditer(text) if free(m)]}
        strong = [(s, e) for k, s, e in base if k != "access"]
        cuts = [m.start() for m in re.finditer(r"\n\s*\n", text)]
        scope = lambda x: sum(c < x for c in cuts)  # noqa: B023, E731
        near = lambda x, others: any(y != x and y[0] <= x[1] + 200 and y[1] >= x[0] - 200 and scope(x[0]) == scope(y[0]) for y in others)  # noqa: B023, E731
        ids = weak["identifier"] + [(s, e) for k, s, e in base if k == "access"]
        done = [x for x in weak["secret"] if near(x, ids)]
        want = [("identifier", *x) for x in weak["identifier"] if near(x, strong + weak["secret"])] + [("secret", *x) for x in done] + [("endpoint", *x) for x in weak["endpoint"] if near(x, strong + done)]
        assert sorted(found) == sorted(want), text


def plain_scores(rows, target):
    """Losses by plain counting: rows (id, text), the places that are of the target."""
    grams = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        grams.append(Counter(zip(["<s>", *w], [*w, "</s>"])) if w else Counter())
    size = lambda k: len((rows[k][1] or "").encode())
    here, there = (sum(size(k) for k in range(len(rows)) if (k in target) == side) for side in (True, False))
    scale = here / there if here and there else 1.0
    pairs, contexts, share = [Counter(), Counter()], [Counter(), Counter()], Counter()
    for k, g in enumerate(grams):
        for (v, w), m in g.items():
            pairs[k not in target][v, w] += m
            contexts[k not in target][v] += m
            share[w] += m
    n_all = sum(share.values())

    words = [Counter(), Counter()]
    for side in (0, 1):
        for (_, w), m in pairs[side].items():
            words[side][w] += m
    totals = [sum(x.values()) for x in words]

    def given(side, by, v, w, pair=0, context=0, word=0, n=0):
        p = (by * (words[side][w] - word) + lm_score.NU * share[w] / n_all) / (by * (totals[side] - n) + lm_score.NU)
        return (by * (pairs[side][v, w] - pair) + lm_score.MU * p) / (by * (contexts[side][v] - context) + lm_score.MU)

    for side, by in ((0, 1.0), (1, scale)):  # the probabilities after any context sum to one
        for v in [*contexts[side]][:20]:
            assert abs(sum(given(side, by, v, w) for w in share) - 1) < 1e-9
    out = []
    for k, g in enumerate(grams):
        n, own, ends = sum(g.values()), Counter(), Counter()
        for (v, w), m in g.items():
            own[v] += m
            ends[w] += m
        loss = []
        for side, by in ((0, 1.0), (1, scale)):
            mine = (k in target) == (side == 0)
            loss.append(-sum(m * math.log(given(side, by, v, w, m * mine, own[v] * mine, ends[w] * mine, n * mine)) for (v, w), m in g.items()) / n if n else None)
        out.append((rows[k][0], max(n - 1, 0), *loss))
    return out


def same_scores(found, want):
    by = lambda r: (str(r[0]), r[1], *[round(x, 6) if x is not None else -1 for x in r[2:4]])
    assert sorted(by((r.doc_id, r.n_tokens, r.loss_target, r.loss_background)) for r in found) == sorted(map(by, want))


def test_losses_by_plain_counting(spark):
    docs = documents(spark).select("doc_id", "text").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs]
    want = plain_scores(rows, {k for k, r in enumerate(rows) if r[0] in good})
    same_scores(lm_score.query(spark, SF).collect(), want)
    # whatever is hot, however many buckets
    told = lm_score.told_apart(documents(spark), spark.createDataFrame([(i,) for i in good], "doc_id long"))
    same_scores(lm_score.score(told, hot_share=0.3, bucket_bytes=20_000).collect(), want)


def test_losses_of_repeated_and_empty_rows(spark):
    rows = [(1, "a b a b c"), (1, "a b a b c"), (None, "c c d"), (None, None), (2, " \t"), (3, "x " * 70_000 + "a b"), (4, "a b"), ((1 << 60) + 1, "c d e")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, target int").drop("target")
    for ids in ([1], [], [1, 2, 3, 4]):
        target = {k for k, r in enumerate(rows) if r[0] in ids}
        told = lm_score.told_apart(df, spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        same_scores(lm_score.score(told).collect(), plain_scores(rows, target))


def test_packed_ngrams():
    rng = np.random.default_rng(2)

    def drawn(n, last=None):
        h = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64).repeat(rng.integers(1, 4, n)))
        x = lm_score.Postings(h, h, np.arange(len(h)))
        x.text, x.times = rng.integers(0, 60_000, len(h)), rng.integers(1, 1000, len(h))
        x.last, x.own = (h >> np.uint64(9), rng.integers(1, 500, len(h))) if last else (None, None)
        return x

    target, tokens = rng.random(60_000) < 0.5, rng.integers(1, 1 << 30, 60_000)
    for n in (3000, 0, 50_000):
        words, pairs = drawn(n), drawn(n, True)
        *got, who, sizes = lm_score.unpack(lm_score.pack(words, pairs, target, tokens))
        assert (who == sorted({*words.text.tolist(), *pairs.text.tolist()})).all() and (sizes == tokens[who]).all()
        for x, found in zip((words, pairs), got):
            assert all((a == b).all() for a, b in zip(found, (x.h, x.text, x.times, target[x.text], x.last, x.own)))


def test_losses_tell_quality_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = lm_score.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg("score").alias("s")).collect()
    by = {r.quality: r.s for r in got}
    assert by[1] < by[0]


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(20):
        supply = [rng.randrange(50) for _ in range(5)]
        demand = reshard.equal_capacities(sum(supply), 7)
        flow = reshard.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        assert all(sum(v for (i, _), v in flow.items() if i == k) == x for k, x in enumerate(supply))
        assert all(sum(v for (_, j), v in flow.items() if j == k) == x for k, x in enumerate(demand))
        assert sum(v for (i, j), v in flow.items() if i == j) == sum(map(min, supply, demand))


def test_shards_are_near_equal_and_stay(spark, tmp_path):
    docs = documents(spark)
    placed = reshard.reshard(docs, F.pmod(F.col("doc_id"), F.lit(3)), 4)
    rows = placed.collect()
    sizes, total = Counter(), sum(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert all(abs(s - total / 4) <= 2 * max(r.size for r in rows) for s in sizes.values())
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= total / 4 + 4 * max(r.size for r in rows)
    old = F.pmod(F.col("doc_id"), F.lit(3))
    plan = reshard.layout(docs, old, 4)
    manifest = reshard.rewrite(docs, old, plan, str(tmp_path / "new"), {i: f"old/{i}" for i in range(3)})
    assert sorted(manifest) == [0, 1, 2, 3] and all("new" in p for p in manifest.values())
    files = {k: spark.read.parquet(p).collect() for k, p in manifest.items()}
    assert {(r.doc_id, k, r.slot) for k, rs in files.items() for r in rs} == {(r.doc_id, r.shard, r.slot) for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for rs in files.values() for r in rs)
    one = reshard.layout(docs, F.lit(0), 1)
    assert reshard.rewrite(docs, F.lit(0), one, str(tmp_path / "none"), {0: "old/0"}) == {0: "old/0"}


def test_small_blocks_and_repeated_rows(spark, tmp_path):
    """Many blocks, null and repeated ids: no row is lost or multiplied by the rewrite, slots have no gaps."""
    rows = [(None if i % 7 == 0 else i % 50, None if i % 11 == 0 else "x" * (i % 300), f"s{i % 5 if i % 3 else 0}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    old = F.substring("source", 2, 1).cast("int")
    plan = reshard.layout(docs, old, 6, block_bytes=2000)
    assert plan.cuts.count() > 30
    reshard.rewrite(docs, old, plan, str(tmp_path / "new"))
    got = spark.read.parquet(str(tmp_path / "new")).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text or "") + 16
    assert max(sizes.values()) - min(sizes.values()) < 4 * 316
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_index_persists(spark, tmp_path):
    path = str(tmp_path / "index")
    a = spark.createDataFrame([(1, "x  y"), (2, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(0, "x y"), (5, "new"), (6, "new")], "doc_id long, text string")
    exact_dedup.ingest(a, exact_dedup.DigestIndex(spark, path, 3)).collect()
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.ingest(b, exact_dedup.DigestIndex(spark, path, 3)).collect()}
    assert got == {0: (1, False, 1), 5: (5, True, 2), 6: (5, False, 2)}
    index = exact_dedup.DigestIndex(spark, path, 3)
    assert index.rows().count() == 3
    exact_dedup.ingest(b, index).collect()
    assert index.rows().count() == 3


def test_containment_finds_short_items_in_long_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [[word() for _ in range(rng.randrange(12, 80))] for _ in range(30)]
    rows = []
    for i, item in enumerate(items):
        part = list(item)
        if i % 3 == 1:
            part[len(part) // 2] = "changed"
        if i % 3 == 2:
            part = part[: len(part) // 2]
        text = [word() for _ in range(rng.randrange(0, 6000))] + part + [word() for _ in range(50)]
        rows.append((i, " ".join(text).upper()))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [grams(t.lower().split()) for _, t in rows]
    want = {(d, i) for d, s in enumerate(sets) for i, item in enumerate(items) if len(grams(item) & s) >= 0.8 * len(grams(item))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(df, bench).collect()} == want and len(want) >= 12


def test_pages_of_held_out_layouts():
    model = html_extract.default_model()
    right = total = 0
    for html, y in html_extract.layouts(60, seed=99):
        page = html_extract.blocks(html)
        assert len(page) == len(y)
        right += sum(a == b for a, b in zip(model.decode(page), y))
        total += len(y)
    assert right / total > 0.97


def test_deep_pages_in_bounded_memory():
    import tracemalloc

    model = html_extract.default_model()
    for page in ("<div>x" * 20_000, "".join(f'<div class="c{chr(97 + i % 26)}{"ab"[i % 2] * (i % 40)}">x' for i in range(20_000)), "".join(f"<x{i}>y<p>z" for i in range(20_000)), "<p>a<b>" * 20_000 + "</b>" * 20_000):
        tracemalloc.start()
        html_extract.main_text(page, model)
        assert tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()


def test_viterbi_is_the_best_sequence():
    from itertools import product

    model = html_extract.default_model()
    for html, _ in html_extract.layouts(6, seed=5):
        page = html_extract.blocks(html)[:9]
        s = model.scores(page)
        value = lambda y: model.first[y[0]] + sum(s[i][k] for i, k in enumerate(y)) + sum(model.pair[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert math.isclose(value(model.decode(page)), max(value(y) for y in product((0, 1), repeat=len(page))))


def test_blocks_decode_and_join():
    page = html_extract.blocks('<div>a&nbsp;&lt;b\n c<script>var t="</p>";</script><!-- x --><p>d<br>e<p hidden>no<p>&#x41;')
    assert [b.text for b in page] == ["a <b c", "d", "e", "A"]


def test_articles_of_the_pages_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    model = html_extract.default_model()
    for r in rows:
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|br|h1)>", inside)]
        assert html_extract.main_text(r.html, model) == "\n".join(p for p in parts if p)


def segmentations(word):
    """Every segmentation of a word with its log-probability: pieces looked up one by one, weights by Zipf's law over the merge ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_path())
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    scores = sorted({model.get_score(i) for i in plain}, reverse=True)
    weight = {model.id_to_piece(i): (i, -math.log(scores.index(model.get_score(i)) + 10)) for i in plain if model.id_to_piece(i) in word}

    def rest(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in weight:
                i, w = weight[word[at:end]]
                for ids, total in rest(end):
                    yield (i, *ids), w + total

    every = dict(rest(0))
    z = math.log(sum(map(math.exp, every.values())))
    return {ids: w - z for ids, w in every.items()}


def test_sampling_without_replacement():
    v = sentence_pieces.vocabulary(sentence_pieces.default_path())
    every = segmentations("▁hello")
    assert len(every) > 10
    n, k = 20_000, 2
    got = sentence_pieces.sample_batch(v, ["hello"] * n, np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64), k)
    at = np.concatenate([[0], np.cumsum(got["size"])])
    seen, values = defaultdict(dict), defaultdict(dict)
    estimate, square = Counter(), Counter()
    for i, (r, s) in enumerate(zip(got["row"], got["sample"])):
        ids = seen[r][s] = tuple(got["ids"][at[i] : at[i + 1]].tolist())
        values[r][s] = got["perturbed"][i]
        assert math.isclose(got["log_prob"][i], every[ids], abs_tol=1e-9) and 0 < got["inclusion"][i] <= 1
        # the reciprocal of the inclusion score estimates 1 for each segmentation without bias
        estimate[ids] += 1 / got["inclusion"][i]
        square[ids] += 1 / got["inclusion"][i] ** 2
    assert all(x[0] != x[1] for x in seen.values()) and all(x[0] >= x[1] for x in values.values())
    pairs = Counter((x[0], x[1]) for x in seen.values())
    top = sorted(every, key=every.get)[-4:]
    for a in top:
        assert abs(estimate[a] / n - 1) < 5 * math.sqrt(square[a]) / n
        for b in top:
            if a != b:
                want = math.exp(every[a] + every[b]) / (1 - math.exp(every[a]))
                assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n)


def test_inclusion_is_one_when_nothing_is_left_out():
    v = sentence_pieces.vocabulary(sentence_pieces.default_path())
    every = segmentations("▁it")
    got = sentence_pieces.sample_batch(v, ["it"], np.array([5], np.uint64), len(every) + 3)
    at = np.concatenate([[0], np.cumsum(got["size"])])
    assert {tuple(got["ids"][at[i] : at[i + 1]].tolist()) for i in range(len(at) - 1)} == set(every)
    assert (got["inclusion"] == 1).all()


def test_lattices_are_kept_and_forgotten(monkeypatch):
    """Samples don't depend on what a worker has kept; a very long word is a lattice like any other."""
    path = sentence_pieces.default_path()
    texts = ["some words and others", "x" * 20_000, "些" * 3000 + "y" * 17_000, "words that others had", "and some more words"] * 3
    keys = np.arange(len(texts)).astype(np.uint64)
    whole = sentence_pieces.sample_batch(sentence_pieces.Vocabulary(path), texts, keys, 2)
    monkeypatch.setattr(sentence_pieces, "CACHE", 6)
    v = sentence_pieces.Vocabulary(path)
    at = np.concatenate([[0], np.cumsum(whole["size"])])
    for i, t in enumerate(texts):
        alone = sentence_pieces.sample_batch(v, [t], keys[i : i + 1], 2)
        rows = np.flatnonzero(whole["row"] == i)
        assert alone["ids"].tolist() == [x for j in rows for x in whole["ids"][at[j] : at[j + 1]].tolist()]
        assert np.allclose(alone["log_prob"], whole["log_prob"][rows]) and np.allclose(alone["inclusion"], whole["inclusion"][rows])
        assert v.decode(alone["ids"][: alone["size"][0]]) == t
    assert len(v.place) <= 6 + 5


def test_samples_do_not_depend_on_batches():
    v = sentence_pieces.vocabulary(sentence_pieces.default_path())
    texts = ["one two  three", "", "zażółć gęślą\njaźń", "▁ literal ▁", "😀 tab\t"]
    keys = np.arange(5).astype(np.uint64)
    whole = sentence_pieces.sample_batch(v, texts, keys, 3)
    at = np.concatenate([[0], np.cumsum(whole["size"])])
    for i, t in enumerate(texts):
        alone = sentence_pieces.sample_batch(v, [t], keys[i : i + 1], 3)
        mine = [whole["ids"][at[j] : at[j + 1]].tolist() for j in np.flatnonzero(whole["row"] == i)]
        cut = np.concatenate([[0], np.cumsum(alone["size"])])
        assert sorted(mine) == sorted(alone["ids"][cut[j] : cut[j + 1]].tolist() for j in range(len(alone["row"])))
        assert all(v.decode(ids) == t for ids in mine) and len({*map(tuple, mine)}) == len(mine)


def test_calls_are_ordered_and_checked(spark):
    calls = [(1, "a", "f", {"x": "1"}, []), (1, "b", "f", {"x": '"s"', "z": "0"}, ["a"]), (1, "c", "f", {}, ["b", "a"]), (1, "d", "g", None, ["e"]), (1, "e", "f", {"x": "2"}, ["d"]), (1, "h", "f", {"x": "2"}, ["e"]), (1, "i", "f", {"x": "3"}, ["nope"])]
    calls += [(2, f"k{i}", "f", {"x": str(i)}, [f"k{i - 1}"] if i else []) for i in range(40)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, tool string, arguments map<string,string>, needs array<string>")
    results = spark.createDataFrame([(1, "a", "done"), (1, "zz", "lost"), (2, "b", "of another conversation")], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("f", ["x"], {"x": "integer"})], "tool string, required array<string>, types map<string,string>")
    got = {r.call_id: r for r in tool_calls.link(df, results, schemas).collect()}
    assert [got[c].level for c in "abcdehi"] == [0, 1, 2, None, None, None, 0]
    assert [got[f"k{i}"].level for i in range(40)] == list(range(40))
    assert got["b"].problems == ["unknown:z", "type:x"] or sorted(got["b"].problems) == ["type:x", "unknown:z"]
    assert got["c"].problems == ["missing:x"] and got["d"].problems == ["tool", "cycle"] and got["h"].problems == ["cycle"] and got["i"].problems == ["reference:nope"]
    assert got["b"].call_json == '{"arguments":{"x":"s","z":0},"id":"b","name":"f"}' and got["a"].linked
    assert not got["b"].linked
    assert sorted(r.call_id for r in tool_calls.orphans(df, results).collect()) == ["b", "zz"]


def test_equal_ids_in_two_conversations(spark):
    calls = spark.createDataFrame([(1, "x", "f", {}, []), (2, "x", "f", {}, ["y"]), (2, "y", "f", {}, []), (None, "x", "f", {}, ["y"]), (3, None, "f", {}, [])], "conv_id long, call_id string, tool string, arguments map<string,string>, needs array<string>")
    results = spark.createDataFrame([(1, "x", "one"), (2, "x", "two"), (None, "x", "none")], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("f", [], {})], "tool string, required array<string>, types map<string,string>")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert len(got) == 5 and [got[k].level for k in ((1, "x"), (2, "x"), (2, "y"), (None, "x"), (3, None))] == [0, 1, 0, None, None]
    assert '"one"' in got[1, "x"].result_json and '"two"' in got[2, "x"].result_json and got[None, "x"].result_json is None


def test_canonical_json(spark):
    """Against json.dumps with sorted keys: nested values, escapes, numbers, malformed texts."""
    import json

    good = ['{"b": [1, 2, {"z": null, "a": "x"}],\n "a": {"y": 1.50, "x": true}}', ' "caf\\u00e9 \\/ \\t" ', "[ ]", "{}", "12", "-0", "1.0", "2e3", "0.25", "false", "null", '"a\\"b\\\\"', "[" * 40 + "1.0" + "]" * 40, '{"x": "1.0, 2.0", "y": 3.0, "z": [4.0, 5]}']
    bad = ["{not json}", "[1,]", '"open', "01", "nul", '{"a":1,"a":2}', "", "'x'", '"a" x', "1, 2", "1 2", "1e400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tool_calls.canonical(F.col("t")).alias("c")).collect()}

    def plain(v):
        if isinstance(v, float) and v == int(v):
            return int(v)
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v

    for i, t in enumerate(good):
        assert got[i] == json.dumps(plain(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False), t
    assert all(got[len(good) + i] is None for i in range(len(bad)))


def test_nested_schemas(spark):
    calls = [(1, "a", "f", {"o": '{ "n": 1, "s": {"t": "x"} }'}, []), (1, "b", "f", {"o": '{"n": "1"}'}, []), (1, "c", "f", {"o": "{not json}", "q": "1"}, []), (1, "d", "f", {"o": '{"s": {}}'}, [])]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, tool string, arguments map<string,string>, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("f", ["o", "o.n", "o.s.t"], {"o": "object", "o.n": "integer", "o.s.t": "string"})], "tool string, required array<string>, types map<string,string>")
    got = {r.call_id: r for r in tool_calls.link(df, results, schemas).collect()}
    assert got["a"].problems == [] and got["a"].call_json == '{"arguments":{"o":{"n":1,"s":{"t":"x"}}},"id":"a","name":"f"}'
    assert got["b"].problems == ["type:o.n"]
    assert got["c"].problems == ["json:o", "unknown:q"]
    assert got["d"].problems == ["missing:o.n", "missing:o.s.t"]


def test_language_model_by_plain_counts(spark):
    import zlib

    docs = documents(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    low = 0xFFFFFFFF
    counts = {}
    for i, text, lang in rows:
        if text is None or lang is None or got[i]:
            continue
        c = counts.setdefault(lang, Counter())
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = [0, *map(ord, word), 0]
            for a, b, d in zip(padded, padded[1:], padded[2:]):
                h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ d * 0xC2B2AE35) & low
                c[((h ^ h >> 15) * 0x2C1B3C6D & low) >> 17] += 1
    repeated = docs.where("lang = 'es'").limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n")
    for source in (docs, docs.unionByName(repeated)):  # rows that repeat count once, and crowd no others out
        model = langid.train(langid.learnable(source), 10_000)
        assert model.languages == sorted(counts)
        for lang, log_p in zip(model.languages, model.log_p):
            total = sum(counts[lang].values()) + 0.1 * langid.BUCKETS
            want = np.log([(counts[lang][b] + 0.1) / total for b in range(langid.BUCKETS)])
            assert np.abs(log_p - want).max() < 1e-5
