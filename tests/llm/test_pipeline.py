"""The pipeline's stages against plain Python, and the registry."""

import re

import corpus_pipeline
from strandloom.llm import langid, registry, sentence_pieces
from strandloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_groups(rows):
    ids = sorted(rows)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: grams(rows[i]) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    want = [{i for i, t in rows.items() if any(c.isalpha() for c in t)}]
    want.append(want[0] & set(first.values()))
    want.append(near_groups({i: rows[i] for i in want[1]}))
    want.append({i for i in want[2] if not any(g and len(g & grams(rows[i])) >= 0.8 * len(g) for g in items)})
    assert len(want[3]) < len(want[2]) < len(want[1]) < len(rows)
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:4], want):
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == kept, name
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    back = sentence_pieces.decode(pieces, sentence_pieces.default_path()).collect()
    assert {r.doc_id for r in back} == want[3] and all(r.text == rows[r.doc_id] for r in back)


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontaminate", "sentence_pieces"]
    assert langid.UNKNOWN == "und"


def test_a_worker_holds_few_lattices():
    import numpy as np

    from strandloom.llm import sentence_pieces as S

    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(2_000)) for _ in range(40)]  # 80,000 words, hardly one twice
    v = S.Vocabulary(S.default_path())
    v.most = corpus_pipeline.LATTICES
    most = 0
    for n, t in enumerate(texts):
        S.sample_batch(v, [t], np.array([n], np.uint64), 1)
        most = max(most, sum(x.nbytes for x in v.room.values()))
    assert most < 30e6, most  # of each of an executor's workers
    assert corpus_pipeline.SLICE_CHARS <= 100_000
