"""Column functions on hand-made rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import codes as C
from strandloom.functions import predicates as P
from strandloom.functions import sequences as S
from strandloom.functions import udfs


def col(spark, values, kind="array<string>"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, a {kind}")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def hit(x):
    return x == "X"


def test_cut(spark):
    df = col(spark, [["X", "a", "b"], ["a", "b", "X"], ["a", "X", "b", "X"], ["a", "b", "c"], []])
    a = F.col("a")
    assert values(df, S.cut(a, hit)) == [["X"], ["a", "b", "X"], ["a", "X"], ["a", "b", "c"], []]
    assert values(df, S.cut(a, hit, inclusive=False)) == [[], ["a", "b"], ["a"], ["a", "b", "c"], []]
    assert values(df, S.cut(a, hit, "posterior")) == [["X", "a", "b"], ["X"], ["X", "b", "X"], ["a", "b", "c"], []]
    assert values(df, S.cut(a, hit, "posterior", inclusive=False)) == [["a", "b"], [], ["b", "X"], ["a", "b", "c"], []]
    assert values(df, S.cut(a, hit, nth=2)) == [["X", "a", "b"], ["a", "b", "X"], ["a", "X", "b", "X"], ["a", "b", "c"], []]
    assert values(df, S.cut_inverse(a, hit)) == [["X"], [], [], [], []]


def test_subsequences(spark):
    df = col(spark, [["a", "c", "b"], ["b", "a"], ["a"], ["a", "b", "a", "b"], []])
    p = F.array(F.lit("a"), F.lit("b"))
    assert values(df, S.is_subsequence(p, F.col("a"))) == [True, False, False, True, False]
    assert values(df, S.match_positions(p, F.col("a"))) == [[[0, 2]], [], [], [[0, 1], [2, 3]], []]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=12))
def test_common_subsequence(spark, pairs):
    df = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    rows = df.select("i", "a", "b", udfs.lcs_length("a", "b").alias("n"), udfs.lcs("a", "b").alias("s")).collect()

    def inside(x, y):
        it = iter(y)
        return all(c in it for c in x)

    for r in rows:
        assert r.n == len(r.s) and inside(r.s, r.a) and inside(r.s, r.b)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("aXb"), max_size=8), min_size=1, max_size=12))
def test_cut_parts_make_the_whole(spark, rows):
    df = col(spark, rows)
    both = F.when(F.exists("a", hit), F.concat(S.cut(F.col("a"), hit), S.cut(F.col("a"), hit, "posterior", inclusive=False))).otherwise(F.col("a"))
    assert values(df, both) == rows


def test_many_sequences(spark):
    import random
    from itertools import combinations

    rng = random.Random(5)
    sets = [["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(3)] for _ in range(30)] + [["xyzzyx", "xzyyy", "zyxyx"], ["ab", ""]]
    inside = lambda p, t: all(c in it for it in [iter(t)] for c in p)
    df = spark.createDataFrame([(i, [list(x) for x in s]) for i, s in enumerate(sets)], "i int, a array<array<string>>")
    for s, found in zip(sets, values(df, udfs.lcs_many("a"))):
        best = max(n for n in range(len(s[0]) + 1) for p in combinations(s[0], n) if all(inside(p, t) for t in s))
        assert len(found) == best and all(inside(found, t) for t in s)
    t = spark.createDataFrame([(0, "kitten", "sitting")], "i int, a string, b string")
    assert values(t, udfs.edit_distance()("a", "b")) == [3.0]
    assert values(t, udfs.edit_distance(1, 1, 2)("a", "b")) == [5.0]
    assert values(t, udfs.common_substrings("a", "b")) == [["itt"]]


def test_arrays(spark):
    df = col(spark, [["a", "a", "b"], ["a"], []])
    a = F.col("a")
    assert values(df, S.last_n(a, 2)) == [["a", "b"], ["a"], []]
    assert values(df, S.pad_left(a, 2, F.lit("0"))) == [["a", "b"], ["0", "a"], ["0", "0"]]
    assert values(df, S.ngrams(a, 2)) == [[["a", "a"], ["a", "b"]], [], []]
    assert values(df, S.collapse(a)) == [["a", "b"], ["a"], []]
    t = spark.createDataFrame([(0, "abcd", "abxd")], "i int, a string, b string")
    assert values(t, S.common_prefix_length(F.col("a"), F.col("b"))) == [2]
    assert values(t, S.hamming(F.split("a", ""), F.split("b", ""))) == [1]


def test_parse(spark):
    text = "2031-02-03|X10.5,2031-02-03|Y7;2032-12-31|$"
    df = spark.createDataFrame([(0, text), (1, "2031-02-03|a"), (2, "noTime,2031-02-03|b$")], "i int, a string")
    got = values(df, S.parse(F.col("a")))
    assert [[e.code for e in v] for v in got[0]] == [["X10.5", "Y7"], ["unknown"]]
    assert got[1] is None and [[e.code for e in v] for v in got[2]] == [["b"]]


def test_codes(spark):
    df = col(spark, ["25015", "4.5", "585.", "250.1.5", "E849"], "string")
    c = F.col("a")
    assert values(df, C.repair(c)) == ["250.15", "004.5", "585", "250.15", "E84.9"]
    assert values(df, C.is_supplementary(c)) == [False, False, False, False, True]
    words = col(spark, ["", None, "acute  renal-failure", "!!"], "string")
    assert values(words, C.condense(F.col("a"))) == ["empty", "empty", "Acute_Renal_Failure", "empty"]
    assert values(col(spark, ["0026801031"], "string"), C.ndc_candidates(F.col("a"))) == [["0026-8010-31", "00268-010-31", "00268-0103-1"]]
    d = col(spark, ["250.01", "250.02", "648.01", "249", "250.1"], "string")
    assert values(d, C.is_type1(F.col("a"))) == [True, False, False, False, False]
    assert values(d, C.is_type2(F.col("a"))) == [False, True, False, False, False]
    assert values(d, C.is_gestational(F.col("a"))) == [False, False, True, False, False]
    assert values(d, C.is_diabetes(F.col("a"))) == [True] * 5
    assert values(d, C.is_a(F.col("a"), F.lit("250"))) == [True, True, False, False, True]
    assert values(col(spark, ["I9:250.1", "I10:E11"], "string"), C.strip_diagnosis_prefix(F.col("a"))) == ["250.1", "E11"]


def test_predicates(spark):
    df = col(spark, [["a", "b"], [], None])
    assert values(df, P.has_code(F.col("a"), ["b", "c"])) == [True, False, False]
    assert values(df, P.has_code(F.col("a"), [])) == [True, True, True]
    assert values(df, P.is_case(F.col("a"), ["a", "b"], logic="all"))[:2] == [True, False]
    one = col(spark, ["585.1", "250.0", "309.81"], "string")
    assert values(one, P.disease("ckd stage")(F.col("a"))) == [True, False, False]
    assert values(one, P.code_constraint(F.col("a"), ["585", "250.9"])) == [True, True, False]
    assert values(one, P.in_codes(F.col("a"), ["250.0"], negate=True)) == [True, False, True]
