"""Near copies that differ in a block, and groups whose centre is like none of the others."""

import random

from pyspark.sql import functions as F
from strandloom.llm import simhash
from strandloom.llm.components import components


def shingle_set(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def like(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) >= 0.8 * len(a | b)


def test_cut_and_lengthened_copies(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, kinds = [], ("cut 10", "cut 15", "cut 19", "added 10", "added 20", "added 24")
    for _ in range(30):
        for kind in kinds:
            how, share = kind.split()
            base = text(rng.randrange(200, 1200))
            part = len(base) * int(share) // 100
            copy = base[: len(base) - part] if how == "cut" else base + text(part)
            rows += [(len(rows), " ".join(base), kind), (len(rows) + 1, " ".join(copy), kind)]
    want = {(rows[i][0], rows[i + 1][0]) for i in range(0, len(rows), 2) if like(rows[i][1], rows[i + 1][1])}
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {(r.a, r.b) for r in simhash.similar(df).collect()}
    print({k: sum(rows[a][2] == k for a, _ in want & got) / sum(rows[a][2] == k for a, _ in want) for k in kinds})
    assert len(want) > 150 and got == want


def test_large_group_costs_a_few_links_a_member(spark):
    """600 copies of one text, a few words changed in each: one group, and far fewer links than pairs."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(600):
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 5)):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.similar(df).count() < 600 * 60
    assert [r.doc_id for r in simhash.deduplicate(df).collect()] == [0]


def test_no_pair_of_a_group_stays_uncompared(spark):
    """One bucket of 60 groups of four; the link to a centre holds for its own group alone."""
    rng = random.Random(8)
    sets = []
    for g in range(60):
        base = [g * 1000 + i for i in range(100)]
        for _ in range(4):
            sets.append([x if rng.random() > 0.05 else rng.randrange(10**6, 10**9) for x in base])
    n = len(sets)
    same = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    part = list(range(n))
    for a in range(n):
        for b in range(a):
            if part[a] != part[b] and same(a, b):
                part = [part[b] if p == part[a] else p for p in part]
    s = spark.createDataFrame(list(enumerate(sets)), "row long, s array<long>")
    member = s.select(F.lit(1).cast("long").alias("bucket"), "row", F.lit(n).cast("long").alias("n"))
    to_first = simhash.verified(simhash.to_centres(member).where("a != b"), s, 0.8)
    root = {r.node: r.root for r in components(simhash.settled(member, to_first, s, 0.8), "a", "b").collect()}
    got = [root.get(i, i) for i in range(n)]
    assert all((got[a] == got[b]) == (part[a] == part[b]) for a in range(n) for b in range(a))
    assert len({*part}) < n / 2


def test_lines_in_another_order(spark):
    """x has the lines of z in another order, y is x with one word changed: y goes though z, the centre, is like neither."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    rows = []
    for _ in range(20):
        lines = [" ".join(rng.choice(vocab) for _ in range(6)) for _ in range(40)]
        x = rng.sample(lines, 40)
        y = " ".join(x).split()
        y[100] = "changed"
        rows += [(len(rows) + i, t) for i, t in enumerate(("\n".join(lines), "\n".join(x), " ".join(y)))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in range(60) if i % 3 < 2}
