"""Phrases, ranked search and token files against plain Python, over random rows, edge cases and no rows."""

import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from strandloom.llm import collocations, lexical_search, token_files
from strandloom.llm.common import fresh_path

PATH = token_files.default_tokenizer()
ODD = [(None, "a text without an id", "en"), (3, None, None), (4, "", "en"), (4, "x", "en"), (4, "x", "en"), (5, " \t\n", "en"), ((1 << 60) + 1, "É日本 x y", None), (-7, "w " * 40_000, "de")]


def frame(spark, rows):
    extra = "n long, phrase string, a long, part int, to long, term string, salt int, rank int, value string"
    return spark.createDataFrame([(*r, *[None] * len(extra.split(", "))) for r in rows], f"doc_id long, text string, lang string, {extra}")


# phrases


def plain_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, all_ in f.items():
        found = {p: a for p, a in all_.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and all_[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in found):
                continue
            score, k = min((1000 * a * n[lang] // (all_[p[:k]] * all_[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), all_[p[:k]], all_[p[k:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["aa", "b", "C", "d.", "e,", "É", "x\ty", "\x01z", "\x1c"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(120))), rng.choice(["en", "de", None])) for i in range(60)] + ODD
    for size in (4_000_000, 300):  # one shard, and many
        monkeypatch.setattr(collocations, "SHARD_WORDS", size)
        got = collocations.collocations(frame(spark, rows), least=4, top=40).collect()
        assert sorted(tuple(r) for r in got) == plain_phrases(rows, 4, 5, 40)
    none = frame(spark, rows).where("false")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(frame(spark, ODD[1:2])).count() == 0


def test_automaton():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x = rng.integers(0, 4, 80).astype(np.int32)  # 0 ends a piece
        reach = np.zeros(80, np.int64)
        for i in range(80):
            reach[i] = 0 if x[i] == 0 else 1 if i == 0 or x[i - 1] == 0 else min(reach[i - 1] + 1, 4)
        got = collocations.automaton(x, reach, 4)
        ends = defaultdict(set)
        for i in range(80):
            for d in range(1, reach[i] + 1):
                ends[tuple(x[i - d + 1 : i + 1])].add(i)
        classes = defaultdict(list)
        for sub, at in ends.items():
            classes[frozenset(at), sub[-1]].append(sub)
        want = sorted((len(at), min(map(len, subs)), max(map(len, subs)), max(subs, key=len)) for (at, _), subs in classes.items())
        named = [tuple(x[e - n + 1 : e + 1].tolist()) for e, n in zip(got["end"], got["long"])]
        assert sorted(zip(got["count"], got["short"], got["long"], named)) == want
        for i, link in enumerate(got["link"]):  # the suffix one shorter than the state's shortest is the longest of its link
            if link >= 0:
                assert got["long"][link] == got["short"][i] - 1 and named[i][-got["long"][link] :] == named[link] and got["count"][link] > got["count"][i]
            else:
                assert got["short"][i] == 1


# search


def plain_search(rows, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [Counter(split(t)) for _, t, _ in rows]
    n = [sum(d.values()) for d in docs]
    n_docs, length, df = sum(x > 0 for x in n), sum(n), Counter(t for d in docs for t in d)
    out = []
    for item_id, text in set(items):
        scores = []
        for i, (doc_id, _, _) in enumerate(rows):
            m = 100 - 50 + 50 * n[i] * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * docs[i][t] // (1000 * docs[i][t] + 20 * m)) for t in set(split(text)) if docs[i][t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "Zz", "日本"]
    rows = [(i // 2 if i % 9 else None, rng.choice([" ", "-", "!\n"]).join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(30))), "en") for i in range(300)] + ODD
    items = [(1, "w0 w1 W2"), (2, "zZ, É日本"), (2, "zZ, É日本"), (2, "w39"), (3, None), (None, "w5 w5 w7"), (4, "unseen"), (5, " ".join(words))]
    asked = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int")
    want = plain_search(rows, items, 7)
    for block, run, text in ((16_384, 10_000, 8_000_000), (50, 2, 10)):  # one block and pass, and many; all terms indexed
        for name, value in (("BLOCK_ROWS", block), ("PASS_ITEMS", run), ("PASS_BYTES", text)):
            monkeypatch.setattr(lexical_search, name, value)
        got = lexical_search.search(frame(spark, rows).repartition(3), asked, 7).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert lexical_search.search(frame(spark, rows).where("false"), asked).count() == 0
    assert lexical_search.search(frame(spark, rows), asked.where("false")).count() == 0


def test_carry_arithmetic():
    rng = np.random.default_rng(1)
    values = [rng.integers(0, 1 << rng.integers(1, 40), 200) for _ in range(9)]
    sums = np.zeros((45, 1, 4), np.uint64)
    for v in values:
        lexical_search.add(sums, lexical_search.slices_of(v, np.arange(200), 4)[:, None, :])
    total = sum(values)
    bits = np.unpackbits(sums[:, 0].view(np.uint8), axis=1, bitorder="little")[:, :200].astype(np.int64)
    assert ((bits << np.arange(45)[:, None]).sum(axis=0) == total).all()
    for k in (1, 10, 250):
        chosen = np.flatnonzero(np.unpackbits(lexical_search.best(sums, k)[0].view(np.uint8), bitorder="little"))
        assert sorted(chosen) == sorted(sorted((i for i in range(200) if total[i]), key=lambda i: (-total[i], i))[:k])


# token files


def plain_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_words_encoded_apart_are_the_text_encoded_whole():
    rng = random.Random(1)
    marks = list("ab  \n\t'é日  \x1c\x85<|>s.,1A!́") + ["<|endoftext|>", " the", " \n ", "'ll"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    own = token_files.Encoder(PATH)
    assert [np.frombuffer(x, own.kind).tolist() for x in own.texts(texts)] == plain_ids(texts)


def test_files(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect() if r.doc_id not in (3, 4, 5)] + ODD
    df = frame(spark, rows).repartition(5)
    path = fresh_path(spark, "files")
    monkeypatch.setattr(token_files, "WORDS", 1000)  # workers forget words all the time
    token_files.write(df, path, PATH, 0, file_bytes=30_000)
    got = token_files.positions(spark, path).orderBy("start").collect()
    known = dict(zip([r[1] or "" for r in rows], plain_ids([r[1] or "" for r in rows])))
    crc = lambda t: zlib.crc32(np.array([*known[t or ""], 0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(known[t or ""]) + 1, crc(t)) for i, t, _ in rows)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got if r.doc_id is not None)) + [None]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    some = {r.doc_id: list(r.ids) for r in token_files.fetch(spark, path, [3, -7, 999_999]).collect()}
    assert some == {3: [0], -7: [*known["w " * 40_000], 0]}
    none = fresh_path(spark, "none")
    token_files.write(df.where("false"), none, PATH, 0)
    assert token_files.positions(spark, none).count() == 0


def test_one_file_is_read_in_parts_and_checked():
    import xxhash
    import zstandard

    docs = [np.arange(n, dtype="<u2").tobytes() for n in (0, 5, 70_000, 3)]
    squeeze = zstandard.ZstdCompressor(level=3, write_checksum=True)
    body = token_files.packed([(squeeze.compress(d), len(d), xxhash.xxh64_intdigest(d) & 0xFFFFFFFF) for d in docs], [7, None, -1, 8], (2, 5), 2)
    raw = body + token_files.END.to_bytes(4, "little")
    reads = []

    def opened(data):
        def read(start, size):
            reads.append(size)
            return data[start : start + size]

        return token_files.TokenFile(read, len(data))

    f = opened(raw)
    assert (f.part, f.file, f.doc_ids.tolist(), f.null.tolist(), f.sizes.tolist()) == (2, 5, [7, 0, -1, 8], [False, True, False, False], [0, 5, 70_000, 3])
    reads.clear()
    assert f.ids(3).tolist() == [0, 1, 2] and sum(reads) == f.entries[3, 0]  # nothing but the frame
    # any zstandard reader can read the whole as one stream
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(docs)
    at = int(f.starts[2]) + 40
    broken = opened(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    assert broken.ids(1).tolist() == [0, 1, 2, 3, 4]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(2)
    with pytest.raises(ValueError):
        opened(raw[:-1] + b"x")
