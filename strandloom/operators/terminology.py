"""Hierarchies and name tables as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import numbered, written


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node, ancestor and depth (the shortest way up, 0 for itself) of an acyclic hierarchy of any depth and size.

    Ways are doubled: a round joins those of up to 2^k steps with each other, so a chain of n nodes takes log2(n)
    rounds. Each round is written, as it is read twice. A cycle raises.
    """
    e = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).dropna().distinct(), "edges")
    ways, before = e.withColumn("depth", F.lit(1).cast("long")), None
    while True:
        n, steps, loops = ways.agg(F.count(F.lit(1)), F.sum("depth"), F.count(F.when(F.col("node") == F.col("ancestor"), 1))).first()  # one row
        if loops:
            raise ValueError("the hierarchy has a cycle")
        if (n, steps) == before:
            break
        before = (n, steps)
        on = ways.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        longer = ways.join(on, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        ways = written(ways.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "ways")
    nodes = e.select("node").union(e.select("ancestor")).distinct()
    return ways.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("depth"))).withColumn("depth", F.col("depth").cast("int"))


def descendants(all_: DataFrame, roots: DataFrame, own: bool = True) -> DataFrame:
    """Distinct nodes under any of ``roots`` (node), from a closure."""
    found = all_.join(roots.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return (found if own else found.where("depth > 0")).select("node").distinct()


def leaves(all_: DataFrame, edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node and its leaves: descendants that are nobody's parent."""
    return all_.select(F.col("ancestor").alias("node"), F.col("node").alias("leaf")).join(edges.select(F.col(parent).alias("leaf")).distinct(), "leaf", "left_anti")


def siblings(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node and how many other children its parent has."""
    n = edges.groupBy(parent).agg(F.count(F.lit(1)).alias("_n"))
    return edges.join(n, parent).select(F.col(child).alias("node"), (F.col("_n") - 1).alias("n_siblings"))


def preferred(names: DataFrame, key: str, kind: str, text: str, priority: list[str]) -> DataFrame:
    """Each concept's name of the kind that comes first in ``priority``; other kinds come last, of equal ones the first text."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    order = F.when(place > 0, place).otherwise(len(priority) + 1)
    return names.groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col(text).alias("t")))["t"].alias("name"), F.sort_array(F.collect_set(kind)).alias("kinds"))


def propagate(seed: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Classes (node, class, level) handed on along edges (src, dst): a node without a class takes its neighbours' of the round before."""
    known = written(seed.select("node", "class", F.lit(0).alias("level")), "known")
    for r in range(1, rounds + 1):
        new = known.join(edges, known["node"] == edges["src"]).select(F.col("dst").alias("node"), "class").distinct()
        new = new.join(known.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(r))
        known = written(known.unionByName(new), "known")  # it is read three times in the next round
    return known


def most_frequent_target(rows: DataFrame, key: str, target: str) -> DataFrame:
    n = rows.groupBy(key, target).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(target).alias("t")))["t"].alias(target))


def closest_names(names: DataFrame, text: str, wanted: str, n: int = 10) -> DataFrame:
    """Offline approximate term match: by edit distance, then name."""
    d = F.levenshtein(F.lower(F.col(text)), F.lit(wanted.lower()))
    return names.select(text, d.alias("distance")).orderBy("distance", text).limit(n)


def parents(edges: DataFrame, nodes: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node and each direct parent of ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias(child)).distinct(), child, "left_semi").select(F.col(child).alias("node"), F.col(parent).alias("parent"))


def children(edges: DataFrame, nodes: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    return parents(edges, nodes, parent, child).withColumnRenamed("parent", "child")


def within_set(edges: DataFrame, nodes: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """The edges of which both ends are among ``nodes`` (node)."""
    inside = nodes.select("node").distinct()
    return edges.join(inside.withColumnRenamed("node", child), child, "left_semi").join(inside.withColumnRenamed("node", parent), parent, "left_semi")


def code_set(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Heads and members in one set: node."""
    return edges.select(F.col(child).alias("node")).union(edges.select(parent)).distinct()


def related(edges: DataFrame, node: str, relation: str | None = None, to: str | None = None) -> DataFrame:
    """Edges (source, relation, target) that leave ``node``, of one relation or to one target if given."""
    found = edges.where(F.col("source") == node)
    found = found if relation is None else found.where(F.col("relation") == relation)
    return found if to is None else found.where(F.col("target") == to)


def layers(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node and layer: 0 without parents, else one more than the deepest parent. A cycle raises.

    Runs of nodes with one parent each are jumped by doubling: a chain of n nodes takes log2(n) rounds, and a run that
    is still going on after these is a ring. What is left are nodes with several parents; a round settles those whose
    parents are all settled, and if none is the rest holds a cycle.
    """
    e = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).dropna().distinct(), "edges")
    n_up = written(e.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "parents")
    jump = written(e.join(n_up.where("n = 1"), "node").select("node", "up", F.lit(1).cast("long").alias("length")), "jumps")
    rounds = jump.count().bit_length() + 1
    while True:
        on = jump.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("length").alias("more"))
        longer = jump.join(on, "up", "left").select("node", F.coalesce("far", "up").alias("up"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.col("far").isNotNull().alias("moved"))
        longer = written(longer, "jumps")
        if not longer.where("moved").take(1):
            break
        jump, rounds = longer.drop("moved"), rounds - 1
        if rounds < 0:
            raise ValueError("the hierarchy has a cycle")
    nodes = e.select("node").union(e.select("up")).distinct()
    known = written(nodes.join(n_up, "node", "left_anti").select("node", F.lit(0).cast("long").alias("layer")), "layers")
    far = jump.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("length").alias("more"))
    several = e.join(n_up.where("n > 1"), "node", "left_semi").join(far, "up", "left")
    left = written(several.select("node", F.coalesce("far", "up").alias("up"), (1 + F.coalesce("more", F.lit(0))).alias("length")), "several")
    while left.take(1):
        there = left.join(known.select(F.col("node").alias("up"), "layer"), "up", "left")
        ready = there.groupBy("node").agg(F.max(F.col("layer") + F.col("length")).alias("layer"), F.count_if(F.col("layer").isNull()).alias("open")).where("open = 0").drop("open")
        ready = written(ready, "ready")
        if not ready.take(1):
            raise ValueError("the hierarchy has a cycle")
        known = written(known.unionByName(ready), "layers")
        left = written(left.join(ready, "node", "left_anti"), "several")
    below = jump.join(known.select(F.col("node").alias("up"), "layer"), "up").select("node", (F.col("layer") + F.col("length")).alias("layer"))
    return known.unionByName(below)


def linearized(layered: DataFrame, suffix: str = r"_\d+$") -> DataFrame:
    """The nodes of ``layers`` in one order: by layer, then name; index suffixes are dropped."""
    return numbered(layered, ["layer", "node"], "place").select("place", F.regexp_replace("node", suffix, "").alias("node"))


def described(codes: DataFrame, code: str, tables: list[DataFrame], default: str = "unknown") -> DataFrame:
    """``codes`` with a description: from the first of ``tables`` (code, description) that has one, else the default."""
    out, found = codes, []
    for i, t in enumerate(tables):
        one = t.groupBy(F.col("code").alias(code)).agg(F.min("description").alias(f"_d{i}"))
        out, found = out.join(one, code, "left"), [*found, f"_d{i}"]
    return out.withColumn("description", F.coalesce(*found, F.lit(default))).drop(*found)


def codes_described(table: DataFrame, pattern: str) -> DataFrame:
    """Codes whose description matches a pattern, whatever the case."""
    return table.where(F.col("description").rlike(f"(?i){pattern}")).select("code").distinct()


def concept_for_name(names: DataFrame, wanted: str, kinds: list[str] | None = None) -> DataFrame:
    """The concept (concept, name, kind) most often named like ``wanted``: by prefix, then anywhere, then with the last word dropped, until there is a hit.

    All tries are one pass: each row gets the place of the first try it meets, and the smallest place that occurs wins.
    """
    rows = names if kinds is None else names.where(F.col("kind").isin(*kinds))
    words, place, n = wanted.lower().split(), F.lit(None).cast("int"), 0
    tries = []
    for k in range(len(words), 0, -1):
        text = " ".join(words[:k])
        tries += [F.lower("name").startswith(text), F.lower("name").contains(text)]
    for n in range(len(tries) - 1, -1, -1):
        place = F.when(tries[n], n).otherwise(place)
    hits = rows.withColumn("_try", place).where("_try is not null").groupBy("_try", "concept").agg(F.count(F.lit(1)).alias("n"))
    return hits.orderBy("_try", F.desc("n"), "concept").limit(1).select("concept", "n", F.col("_try").alias("tries"))


def distinct_values_of(rows: DataFrame, key: str, value: str, wanted: str | int) -> DataFrame:
    """The distinct values of one concept (drug codes, classes)."""
    return rows.where(F.col(key) == wanted).select(value).distinct()


def split_classes(rows: DataFrame, key: str, classes: str, sep: str = "|") -> DataFrame:
    """key and class: a concept's classes out of one text."""
    return rows.select(key, F.explode(F.split(classes, f"[{sep}]")).alias("class")).where("class <> ''").distinct()


def names_of(names: DataFrame, wanted: str, preferred_kinds: list[str] | None = None) -> DataFrame:
    """Name, source and kind of a concept. '@' and what follows is cut; a leading '-' stands for its negation."""
    negated, concept = wanted.startswith("-"), wanted.lstrip("-").split("@")[0]
    found = names.where(F.col("concept") == concept)
    found = found if preferred_kinds is None else found.where(F.col("kind").isin(*preferred_kinds))
    return found.select("concept", "name", "source", "kind", F.lit(negated).alias("negated"))


def json_tree_edges(trees: DataFrame, json: str, name: str = "name", children: str = "children") -> DataFrame:
    """child and parent of all nodes of nested JSON texts of any depth: {name: ..., children: [...]}. Malformed texts and nodes without a name give none.

    Texts become variants once; a round takes the children out of a level, until there are none.
    """
    child = lambda c: F.col(c).cast("string")
    level = trees.select(F.try_parse_json(json).alias("v")).select(F.try_variant_get("v", f"$.{name}", "string").alias("parent"), F.try_variant_get("v", f"$.{children}", "array<variant>").alias("below"))
    level, found = written(level.where("below is not null"), "level"), None
    while level.take(1):
        nodes = level.select("parent", F.explode("below").alias("v"))
        nodes = nodes.select("parent", F.try_variant_get("v", f"$.{name}", "string").alias("child"), F.try_variant_get("v", f"$.{children}", "array<variant>").alias("below"))
        nodes = written(nodes, "level")
        edges = nodes.where("child is not null and parent is not null").select(child("child").alias("child"), child("parent").alias("parent"))
        found = edges if found is None else found.unionByName(edges)
        level = nodes.where("below is not null").select(F.col("child").alias("parent"), "below")
    return found.distinct() if found is not None else trees.sparkSession.createDataFrame([], "child string, parent string")


def siblings_of(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node and sibling: the other children of each of its parents, a row each."""
    other = edges.select(parent, F.col(child).alias("sibling"))
    return edges.join(other, parent).where(F.col(child) != F.col("sibling")).select(F.col(child).alias("node"), "sibling").distinct()


def keyword_groups(rows: DataFrame, key: str, text: str, at_most: int, shortest: int = 4) -> DataFrame:
    """key and group (its smallest key): descriptions that share a keyword, directly or over others.

    Keywords are the words of ``shortest`` letters or more that at most ``at_most`` descriptions have: commoner ones tell
    nothing. A keyword links its descriptions to the first of them, so a keyword of n rows costs n.
    """
    from .graphs import components

    words = rows.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), 1))).alias("w")).where(F.length("w") >= shortest)
    heads = words.groupBy("w").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, at_most))
    found = components(words.join(heads, "w").select(F.col("first").alias("a"), F.col("k").alias("b")))
    return rows.select(F.col(key).alias("k")).distinct().join(found.withColumnRenamed("node", "k"), "k", "left").select(F.col("k").alias(key), F.coalesce("component", "k").alias("group"))
