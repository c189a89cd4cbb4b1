"""Similarity selection, pair scoring with lossless blocking, clusters and group summaries.

Items are rows with ``tab_id``, an ``item`` key, ``seq`` (input order) and ``f`` (functions.terms.features). Nothing is
compared across tabs. Items that no term tells apart are one class, so copies are never paired one by one; where pairs are only
counted, those whose URL term follows from shapes are counted by groups. Blocking follows
from the weights: unless bare host, directory and extension agree a pair scores at most 0.79, without a common bare host 0.7425, without a
common domain at most 0.6725, so above these thresholds an equi-join finds all links; for the range below, the third kind of
pair must agree in type and in the first two nodes from the root. Down to LOOSEST, pairs of different domains must share
either tokens (where a path is missing: an inverted index with length and prefix filters) or a prefix of their paths from the
root, both as long as the weights ask; only below that are all pairs of a tab scored, which its display limit bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import terms as T
from lodestone.functions import url as U
from lodestone.functions.core import let
from lodestone.storage import written


def with_features(items: DataFrame, **columns: str) -> DataFrame:
    """Adds ``f``. columns: names of url, mime, width, height, path, counts, in_group, depth where they differ or exist.

    It comes out of a generator, so that what compares features does not carry their definition into its conditions.
    """
    names = {"url": "url", "mime": "mime_type", "width": "width", "height": "height"} | columns
    features = let(F.struct(*(F.col(v).alias(k) for k, v in names.items())), lambda x: T.features(**{k: x[k] for k in names})).alias("f")
    return items.select(*(c for c in items.columns if c != "f"), F.inline(F.array(F.struct(features))))


def _pairs(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b.hint("merge"), (F.col("l.tab_id") == F.col("r.tab_id")) & (F.col("l.seq") < F.col("r.seq")) & on)


#: What pairs of different domains score at most: without a term for URLs beyond 0.35 of its weight, and none for hosts.
_W = K.WEIGHTS
_URL_APART = 0.35 * _W["url"]
#: Pairs without a common path score at most this when type or dimensions tell nothing either, so above it both must agree.
LOOSEST = _URL_APART + _W["structure"] * K.NEUTRAL + _W["dimension"]


def _least_jaccard(threshold: float) -> float:
    """What the tokens of two items of different domains must have in common where a path is missing."""
    return (threshold - _W["structure"] * K.NEUTRAL - _W["dimension"] - _W["type"]) / _W["url"]


def _by_tokens(items: DataFrame, threshold: float) -> DataFrame:
    """l and r: candidates of different domains, a path missing, that share enough tokens.

    Tokens are ordered by frequency in their tab, rare first. Two sets of n and m tokens with a Jaccard index of j or more
    share at least j / (1 + j) * (n + m) tokens, so one of the first n - that + 1 tokens of each is common; each pair of
    sizes has its own keys, for their prefixes differ. A pair is taken at the first token that its prefixes share.
    """
    least = _least_jaccard(threshold)
    able = items.where((F.col("f.width") > 0) & (F.col("f.height") > 0) & (F.col("f.top") != "") & (F.col("f.pattern.host") != ""))
    tokens = able.select("tab_id", "seq", F.explode(F.array_distinct("f.pattern.tokens")).alias("token"))
    often = tokens.groupBy("tab_id", "token").agg(F.count("*").alias("n"))
    ordered = tokens.join(often.hint("merge"), ["tab_id", "token"]).groupBy("tab_id", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    sizes = ordered.groupBy("tab_id").agg(F.collect_set(F.size("tokens")).alias("sizes"))  # of one tab: as many as tokens a URL has
    n = F.size("tokens")
    sized = ordered.join(sizes.hint("merge"), "tab_id").select("tab_id", "seq", "tokens", n.alias("n"), F.explode("sizes").alias("m")).where(F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
    share = F.greatest(F.lit(1), F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-9)).cast("int")
    prefix = sized.select("tab_id", "seq", "n", "m", F.slice("tokens", F.lit(1), F.greatest(F.col("n") - share + 1, F.lit(0))).alias("prefix"))
    keyed = prefix.select("*", F.explode("prefix").alias("token"))
    whole = able.select("tab_id", "seq", F.struct(*able.columns).alias("row"))
    rows = keyed.join(whole.hint("merge"), ["tab_id", "seq"])
    own = F.struct(F.col("row.f.top").alias("top"), F.least("n", "m").alias("low"), F.greatest("n", "m").alias("high")).alias("key")
    rows = rows.select("tab_id", "seq", "n", "m", "prefix", "token", own, "row")
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("tab_id", "token", "key")]
    meet = (F.col("x.seq") < F.col("y.seq")) & (F.col("x.n") == F.col("y.m")) & (F.col("y.n") == F.col("x.m"))
    once = F.get(F.array_intersect("x.prefix", "y.prefix"), F.lit(0)) == F.col("x.token")
    found = x.join(y.hint("merge"), same[0] & same[1] & same[2] & meet & once).select(F.col("x.row").alias("l"), F.col("y.row").alias("r"))
    return found.where((F.size("l.f.root") == 0) | (F.size("r.f.root") == 0))


def _by_paths(items: DataFrame, threshold: float) -> DataFrame:
    """l and r: candidates of different domains whose paths have a common prefix that is long enough for their structure."""
    structure = (threshold - _URL_APART - _W["dimension"] - _W["type"]) / _W["structure"]
    share = max(0.0, structure - 0.15)  # a repeated group adds 0.15 to the share of common nodes
    need = lambda m: max(1, math.ceil(share * m - 1e-9))
    depths = F.array(*(F.array(F.lit(m), F.lit(need(m))) for m in range(1, MAX_DEPTH + 1)))
    rooted = items.where((F.size("f.root") > 0) & (F.col("f.pattern.host") != ""))
    fits = F.filter(depths, lambda d: (d[0] >= F.size("f.root")) & (d[1] <= F.size("f.root")))
    rows = rooted.select("tab_id", "seq", F.struct(*rooted.columns).alias("row"), F.explode(fits).alias("d"))
    rows = rows.select("tab_id", "seq", "row", F.col("d")[0].alias("longest"), F.slice("row.f.root", F.lit(1), F.col("d")[1]).alias("start"))
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("tab_id", "start", "longest")]
    meet = (F.col("x.seq") < F.col("y.seq")) & (F.greatest(F.size("x.row.f.root"), F.size("y.row.f.root")) == F.col("x.longest"))
    return x.join(y.hint("merge"), same[0] & same[1] & same[2] & meet).select(F.col("x.row").alias("l"), F.col("y.row").alias("r"))


#: Paths of items have at most this many nodes (index.sanitise); of longer ones the pairs are found without a prefix.
MAX_DEPTH = 16


def candidates(items: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """l and r, whole items, of every pair that can reach the threshold, each pair once."""
    a, b = items.alias("l"), items.alias("r")
    sides = lambda joined: joined.select(F.struct(*(F.col(f"l.{c}").alias(c) for c in items.columns)).alias("l"), F.struct(*(F.col(f"r.{c}").alias(c) for c in items.columns)).alias("r"))
    bare = (F.col("l.f.pattern.bare") == F.col("r.f.pattern.bare")) & (F.col("l.f.pattern.bare") != "")
    domain = (T._domain(F.col("l.f.pattern")) == T._domain(F.col("r.f.pattern"))) & (F.col("l.f.pattern.host") != "") & (F.col("r.f.pattern.host") != "")
    if threshold > 0.79:
        shape = (F.col("l.f.pattern.dir") == F.col("r.f.pattern.dir")) & (F.col("l.f.pattern.ext") == F.col("r.f.pattern.ext"))
        return sides(_pairs(a, b, bare & shape))
    if threshold > 0.7425:
        return sides(_pairs(a, b, bare))
    if threshold > 0.6725:
        return sides(_pairs(a, b, domain))
    if threshold >= 0.62:
        start = lambda f: F.slice(F.col(f"{f}.f.root"), 1, 2)
        alike = (F.col("l.f.top") == F.col("r.f.top")) & (F.col("l.f.top") != "") & (start("l") == start("r")) & (F.size(start("l")) > 0)
        sized = (F.col("l.f.width") > 0) & (F.col("r.f.width") > 0)
        return sides(_pairs(a, b, domain)).unionAll(sides(_pairs(a, b, alike & sized & ~domain)))
    if threshold <= LOOSEST:
        return sides(_pairs(a, b, F.lit(True)))
    apart = lambda df: df.where(~((T._domain(F.col("l.f.pattern")) == T._domain(F.col("r.f.pattern"))) & (F.col("l.f.pattern.host") != "") & (F.col("r.f.pattern.host") != "")))
    found, shallow = sides(_pairs(a, b, domain)), items.where(F.size("f.root") <= MAX_DEPTH)
    if _least_jaccard(threshold) <= 0.35:  # tokens of different domains count no more than that
        found = found.unionAll(apart(_by_tokens(shallow, threshold)))
    # items without a host have no URL term at all; they and deeper paths than an index holds are compared as they are
    odd = lambda f: (F.col(f"{f}.f.pattern.host") == "") | (F.size(F.col(f"{f}.f.root")) > MAX_DEPTH)
    rest = items.where((F.col("f.pattern.host") == "") | (F.size("f.root") > MAX_DEPTH))
    one = sides(_pairs(rest.alias("l"), b, F.lit(True))).unionAll(sides(_pairs(a, rest.alias("r"), ~odd("l"))))
    return found.unionAll(apart(_by_paths(shallow, threshold))).unionAll(apart(one))


def pairs(items: DataFrame, threshold: float = K.THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """tab_id, a, b, a_seq, b_seq, the five terms and total of every pair that reaches the threshold, a before b; of both the
    columns to carry, as a_<name> and b_<name>."""
    return scored(candidates(items, threshold), threshold, carry)


def scored(found: DataFrame, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """pairs() of the given candidates (l and r)."""
    more = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for c in carry for side, name in (("l", "a"), ("r", "b"))]
    l, r = F.col("l.f"), F.col("r.f")
    # no lambda around the score, whose body Spark would interpret; the terms come out of a generator, so that a pair is scored once
    # and no rule of the planner multiplies the conditions. They are only computed for pairs that can reach the threshold.
    terms = F.inline(F.when(T.at_most(l, r) >= threshold - 1e-9, F.array(T.each(l, r))))
    rows = found.select(F.col("l.tab_id").alias("tab_id"), F.col("l.item").alias("a"), F.col("r.item").alias("b"), F.col("l.seq").alias("a_seq"), F.col("r.seq").alias("b_seq"), *more, terms)
    return rows.withColumn("total", T.total({n: F.col(n) for n in T.TERMS})).where(F.col("total") >= threshold)


def classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tab_id, seq = item, the least of the members, n, f of each class; tab_id, item, seq, class of each item). A class is the
    items of a tab that no term tells apart: all that the terms read of them is equal."""
    pattern = F.struct(*(F.col(f"f.pattern.{c}").alias(c) for c in ("host", "bare", "domain", "dir", "ext", "pattern")), F.array_sort(F.array_distinct("f.pattern.tokens")).alias("tokens"))
    read = F.struct(pattern.alias("pattern"), *(F.col(f"f.{c}").alias(c) for c in ("root", "key", "width", "height", "subtype", "top", "typed")))
    rows = items.select("tab_id", "item", "seq", read.alias("f")).withColumn("print", F.sha2(F.to_json("f", {"ignoreNullFields": "false"}), 256))
    rows = written(rows)
    found = written(rows.groupBy("tab_id", "print").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.first("f").alias("f")))
    members = rows.select("tab_id", "item", "seq", "print").join(found.select("tab_id", "print", F.col("seq").alias("class")).hint("merge"), ["tab_id", "print"])
    return found.select("tab_id", "seq", F.col("seq").alias("item"), "n", "f"), members.drop("print")


def class_links(found: DataFrame, threshold: float) -> DataFrame:
    """tab_id, a_seq, b_seq, n, total of any two classes whose items reach the threshold, and of a class with itself where two of
    its own do; n is the number of pairs of items."""
    apart = pairs(found, threshold, carry=("n",)).select("tab_id", "a_seq", "b_seq", (F.col("a_n") * F.col("b_n")).alias("n"), "total")
    own = found.where("n > 1").select("tab_id", F.col("seq").alias("a_seq"), F.col("seq").alias("b_seq"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"), T.score(F.col("f"), F.col("f")).alias("total"))
    return apart.unionAll(own.where(F.col("total") >= threshold))


def pair_totals(items: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """Per tab the number of pairs() and the sum of their totals. Pairs of one shape are counted by groups, so that a tab's work
    grows with its different shapes and not with the square of its items; the others are paired by classes."""
    found, _ = classes(items)
    links = shaped_links(found, threshold).unionAll(unshaped_links(found, threshold))
    return links.groupBy("tab_id").agg(F.sum("n").alias("pairs"), F.sum(F.col("n") * F.col("total")).alias("total"))


def _one_shape(l: str, r: str) -> Column:
    """Whether the URL term of two items follows from shapes: one bare host, and one extension or one pattern."""
    x = lambda c: F.col(f"{l}.pattern.{c}")
    y = lambda c: F.col(f"{r}.pattern.{c}")
    return (x("bare") == y("bare")) & (x("bare") != "") & (((x("ext") == y("ext")) & (x("ext") != "")) | ((x("pattern") == y("pattern")) & (x("pattern") != "")))


def shaped_links(found: DataFrame, threshold: float) -> DataFrame:
    """tab_id, n, total: how many pairs of items of one shape (_one_shape) reach the threshold with that total.

    Given what other terms read of two items, their total follows from the level at which their URLs agree: pattern (1), folder
    and extension (0.75), extension (0.4); an extension and a folder follow from a pattern. A level's groups count their pairs
    by these values, and the pairs that agree at the level above are taken off, in whole numbers.
    """
    p = "f.pattern."
    rest = F.struct(*(F.col(f"f.{c}").alias(c) for c in ("root", "key", "width", "height", "subtype", "top", "typed"))).alias("rest")
    shapes = found.where(F.col(p + "bare") != "").groupBy("tab_id", *(F.col(p + c).alias(c) for c in ("bare", "ext", "dir", "pattern")), rest).agg(F.sum("n").alias("n"))
    shapes = written(shapes.where((F.col("ext") != "") | (F.col("pattern") != "")))
    counts = []
    most = lambda url: _W["url"] * url + sum(w for name, w in _W.items() if name != "url")
    levels = [(1.0, ("bare", "ext", "dir", "pattern"), F.lit(True)), (0.75, ("bare", "ext", "dir"), F.col("ext") != ""), (0.4, ("bare", "ext"), F.col("ext") != "")]
    for i, (url, keys, some) in enumerate(levels):
        if most(url) < threshold - 1e-9:
            break
        group = ["tab_id", *keys]
        rows = shapes.where(some & (F.col("pattern") != "") if i == 0 else some).groupBy(*group, "rest").agg(F.sum("n").alias("n"))
        other = rows.select(*group, F.col("rest").alias("rest_b"), F.col("n").alias("n_b"))
        both = rows.join(other.hint("merge"), group).where(F.col("rest") <= F.col("rest_b"))
        n = F.when(F.col("rest") == F.col("rest_b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("n_b"))
        both = both.select("tab_id", F.col("rest").alias("a"), F.col("rest_b").alias("b"), "ext", n.alias("n"))
        counts.append(both.select("tab_id", "a", "b", F.lit(url).alias("url"), "n"))
        if i + 1 < len(levels):  # these agree at the level below too, which is there for extensions alone
            counts.append(both.where("ext <> ''").select("tab_id", "a", "b", F.lit(levels[i + 1][0]).alias("url"), (-F.col("n")).alias("n")))
    rows = found.select("tab_id", rest.alias("a"), rest.alias("b"), F.lit(0.0).alias("url"), "n").limit(0)
    for more in counts:
        rows = rows.unionAll(more)
    rows = rows.groupBy("tab_id", "a", "b", "url").agg(F.sum("n").alias("n")).where("n > 0 and url > 0")
    total = T.total({"url": F.col("url"), "structure": T.structure_similarity(F.col("a"), F.col("b")), "dimension": T.dimension_similarity(F.col("a"), F.col("b")), "type": T.type_similarity(F.col("a"), F.col("b")), "host": F.lit(1.0)})
    return rows.select("tab_id", "n", F.inline(F.array(F.struct(total.alias("total"))))).where(F.col("total") >= threshold)


#: Where a path is missing, pairs that are not of one shape score at most this unless bare host and subtype agree.
_UNSHAPED = _URL_APART + _W["structure"] * K.NEUTRAL + _W["dimension"] + max(0.6 * _W["type"] + _W["host"], _W["type"] + 0.7 * _W["host"])


def unshaped_links(found: DataFrame, threshold: float) -> DataFrame:
    """tab_id, n, total of the other pairs: two classes, or a class with itself. Where a path is missing, they must agree in bare
    host and subtype; their extensions differ or are missing, and are joined by that, so pairs of one shape are not made."""
    if threshold > _UNSHAPED + 1e-9:
        key = ["tab_id", "bare", "subtype"]
        typed = found.where((F.col("f.pattern.host") != "") & F.col("f.typed") & (F.col("f.subtype") != "")).select("*", F.col("f.pattern.bare").alias("bare"), F.col("f.subtype").alias("subtype"), F.col("f.pattern.ext").alias("ext"))
        exts = typed.select(*key, "ext").distinct()
        two = exts.join(exts.select(*key, F.col("ext").alias("with")).hint("merge"), key).where((F.col("ext") != F.col("with")) | (F.col("ext") == "") | (F.col("bare") == ""))
        row = F.struct(*(F.col(c) for c in found.columns))
        left = typed.select(*key, "ext", row.alias("l")).join(two.hint("merge"), [*key, "ext"]).drop("ext")
        right = typed.select(*key, F.col("ext").alias("with"), row.alias("r"))
        pathless = left.join(right.hint("merge"), [*key, "with"]).where((F.col("l.seq") < F.col("r.seq")) & ((F.size("l.f.root") == 0) | (F.size("r.f.root") == 0))).select("l", "r")
        some = pathless.unionAll(candidates(found.where(F.size("f.root") > 0), threshold))
    else:
        some = candidates(found, threshold)
    apart = scored(some.where(~_one_shape("l.f", "r.f")), threshold, ("n",)).select("tab_id", (F.col("a_n") * F.col("b_n")).alias("n"), "total")
    own = found.where((F.col("n") > 1) & ~_one_shape("f", "f")).select("tab_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"), T.score(F.col("f"), F.col("f")).alias("total"))
    return apart.unionAll(own.where(F.col("total") >= threshold))


def pairs_by_class(items: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """tab_id, a, b, a_seq, b_seq, total of pairs(): each two classes are scored once and then written out."""
    found, members = classes(items)
    side = lambda x: members.select("tab_id", F.col("class").alias(f"{x}_seq"), F.struct("seq", "item").alias(x)).hint("merge")
    both = class_links(found, threshold).join(side("a"), ["tab_id", "a_seq"]).join(side("b"), ["tab_id", "b_seq"]).where((F.col("a_seq") != F.col("b_seq")) | (F.col("a.seq") < F.col("b.seq")))
    turned = both.select("tab_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total")
    return turned.select("tab_id", F.col("a.item").alias("a"), F.col("b.item").alias("b"), F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"), "total")


def class_roots(members: DataFrame, labels: DataFrame, links: DataFrame, keys: tuple[str, ...] = ("tab_id",)) -> DataFrame:
    """keys, item, seq, root of each member, given the ``labels`` (keys, seq, root) of classes: a linked class is in one cluster
    with all its members; those of a class without links, not even its own, are alone."""
    linked = links.select(*keys, F.explode(F.array("a_seq", "b_seq")).alias("seq")).distinct().withColumn("linked", F.lit(True))
    known = labels.select(*keys, "seq", "root").join(linked.hint("merge"), [*keys, "seq"], "left").withColumnRenamed("seq", "class")
    out = members.join(known.hint("merge"), ["tab_id", "class"])
    return out.select(*keys, "item", "seq", F.when(F.col("linked"), F.col("root")).otherwise(F.col("seq")).alias("root"))


def select_similar(seeds: DataFrame, items: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """tab_id, item, seq, score of the items at least as similar to any seed of their tab, best first; a seed itself scores 1."""
    return similar_to(seeds, items, threshold).orderBy(F.desc("score"), "seq")


def similar_to(seeds: DataFrame, items: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """The rows of select_similar() in no order."""
    own = seeds.select("tab_id", "item", F.lit(1.0).alias("best"))
    by_seed = items.alias("i").join(seeds.select("tab_id", F.col("f").alias("seed")).alias("s"), "tab_id")
    scored = by_seed.select("tab_id", "item", "seq", T.score(F.col("seed"), F.col("i.f")).alias("score")).groupBy("tab_id", "item", "seq").agg(F.max("score").alias("score"))
    out = scored.join(own, ["tab_id", "item"], "left").withColumn("score", F.coalesce("best", "score")).drop("best")
    return out.where(F.col("score") >= threshold)


def proposal(picked: DataFrame, items: DataFrame, threshold: float = K.THRESHOLD, refused: bool = False) -> DataFrame:
    """What a selection of two or more in a tab suggests beyond itself; nothing after a refusal."""
    several = picked.groupBy("tab_id").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & F.lit(not refused)).select("tab_id")
    found = similar_to(picked.join(several, "tab_id", "left_semi"), items, threshold)
    return found.join(picked.select("tab_id", "item"), ["tab_id", "item"], "left_anti")


def find_similar(items: DataFrame, elements: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """Items similar to those of the given elements (tab_id, element_id), without these."""
    seeds = items.join(elements.select("tab_id", "element_id").distinct(), ["tab_id", "element_id"], "left_semi")
    return similar_to(seeds, items, threshold).join(seeds.select("tab_id", "item"), ["tab_id", "item"], "left_anti")


def seeds_for(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (tab_id, src, page_url) the item it names, by key or else by URL; where there is none, a row made of it."""
    asked = wanted.withColumn("key", U.normalize_url(F.col("src"), F.col("page_url")))
    row = F.struct(*(c for c in items.columns if c != "tab_id"))
    by = items.select("tab_id", F.explode(F.array_distinct(F.array("normalized_url", "url"))).alias("name"), "seq", row.alias("row"))
    named = asked.select("tab_id", "src", "key", F.explode(F.array_distinct(F.array("key", "src"))).alias("name")).withColumn("direct", (F.col("name") != F.col("key")).cast("int"))
    found = named.join(by, ["tab_id", "name"]).groupBy("tab_id", "src").agg(F.min_by("row", F.struct("direct", "seq")).alias("row"))
    out = asked.join(found, ["tab_id", "src"], "left")
    return out.select("tab_id", "src", F.coalesce(F.col("row.url"), F.col("key")).alias("url"), F.col("row").isNotNull().alias("known"), "row")


def grown(seeds: DataFrame, items: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """The selection with all that is similar to any of it: one step outwards. Its fixed point is the seeds' clusters."""
    picked = similar_to(seeds, items, threshold).select("tab_id", "item")
    return items.join(picked, ["tab_id", "item"], "left_semi")


def still_there(selected: DataFrame, items: DataFrame) -> DataFrame:
    """The selected ids (tab_id, id) that the index still has."""
    return selected.join(items.select("tab_id", "id"), ["tab_id", "id"], "left_semi")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (tab_id, seq, ...) with ``root``: the least seq that links (tab_id, a_seq, b_seq) connect. Labels spread by
    minimum with pointer jumping; each round is written to the folder that the session names."""
    edges = written(links.select("tab_id", F.col("a_seq").alias("x"), F.col("b_seq").alias("y")).unionAll(links.select("tab_id", F.col("b_seq").alias("x"), F.col("a_seq").alias("y"))).distinct())
    label = written(nodes.select("tab_id", "seq", F.col("seq").alias("root")))
    while True:
        near = edges.join(label.withColumnRenamed("seq", "y").hint("merge"), ["tab_id", "y"]).groupBy("tab_id", F.col("x").alias("seq")).agg(F.min("root").alias("near"))
        hooked = label.join(near.hint("merge"), ["tab_id", "seq"], "left").select("tab_id", "seq", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = hooked.select("tab_id", F.col("seq").alias("next"), F.col("next").alias("far"))
        moved = written(hooked.join(jump.hint("merge"), ["tab_id", "next"]).select("tab_id", "seq", F.least("next", "far").alias("root"), F.col("root").alias("was")))
        label = moved.drop("was")
        if not moved.where("root <> was").take(1):
            return nodes.join(label.hint("merge"), ["tab_id", "seq"])


def spanning_forest(links: DataFrame) -> DataFrame:
    """tab_id, a_seq, b_seq, total of a maximum spanning forest of ``links``: the merges of single linkage, from which a cut at
    any threshold follows. In each of Boruvka's rounds every component takes its best link out; links are in one order (total,
    then the pair), so those taken never close a circle longer than two. Components at least halve, and between two of them
    only the best link is kept."""
    best_of = lambda df: df.groupBy("tab_id", "x", "y").agg(F.max("w").alias("w"))
    weight = F.struct("total", (-F.col("a_seq")).alias("a"), (-F.col("b_seq")).alias("b")).alias("w")
    edges = written(best_of(links.select("tab_id", F.col("a_seq").alias("x"), F.col("b_seq").alias("y"), weight)))
    taken = []
    while edges.take(1):
        both = edges.unionByName(edges.select("tab_id", F.col("y").alias("x"), F.col("x").alias("y"), "w"))
        best = written(both.groupBy("tab_id", "x").agg(F.max_by("y", "w").alias("y"), F.max("w").alias("w")))
        taken.append(best.select("tab_id", "w").distinct())
        back = best.select("tab_id", F.col("x").alias("y"), F.col("y").alias("back"))
        mutual = (F.col("back") == F.col("x")) & (F.col("x") < F.col("y"))
        up = written(best.select("tab_id", "x", "y").join(back.hint("merge"), ["tab_id", "y"], "left").select("tab_id", "x", F.when(mutual, F.col("x")).otherwise(F.col("y")).alias("p")))
        moving = True
        while moving:  # until every component of the round points at its root
            further = up.select("tab_id", F.col("x").alias("p"), F.col("p").alias("pp"))
            moved = written(up.join(further.hint("merge"), ["tab_id", "p"]).select("tab_id", "x", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            up, moving = moved.drop("moved"), bool(moved.where("moved").take(1))
        root = lambda c: up.select("tab_id", F.col("x").alias(c), F.col("p").alias(f"p{c}"))
        joined = edges.join(root("x").hint("merge"), ["tab_id", "x"]).join(root("y").hint("merge"), ["tab_id", "y"]).where("px <> py")
        edges = written(best_of(joined.select("tab_id", F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y"), "w")))
    rows = links.select("tab_id", weight).limit(0)
    for more in taken:
        rows = rows.unionByName(more)
    return rows.select("tab_id", (-F.col("w.a")).alias("a_seq"), (-F.col("w.b")).alias("b_seq"), F.col("w.total").alias("total"))


def cuts(nodes: DataFrame, forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold (``cut``) the nodes with ``root``, the least seq of their single-linkage cluster: one spreading of labels
    over the forest's few links for all cuts together."""
    at = F.explode(F.array(*map(F.lit, thresholds)))
    own = F.struct("tab_id", "cut").alias("tab_id")
    layered = nodes.select("*", at.alias("cut")).withColumnRenamed("tab_id", "tab").select(F.struct(F.col("tab").alias("tab_id"), "cut").alias("tab_id"), *(c for c in nodes.columns if c != "tab_id"))
    links = forest.select("*", at.alias("cut")).where(F.col("total") >= F.col("cut")).select(own, "a_seq", "b_seq")
    return components(layered, links).select("tab_id.*", *(c for c in nodes.columns if c != "tab_id"), "root")


#: Links (of pass one) and rows of whole tabs (of pass two) that a task looks at together.
LINKS_AT_ONCE = 500_000
_LINK = "tab_id long, a_seq long, b_seq long, total double"


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """A number per different row of the columns, and how many there are; numbers follow the order of rows."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:  # numbers stay below the rows' count, so the product fits
        codes, values = pd.factorize(c, sort=True)
        out, found = pd.factorize(out * max(len(values), 1) + codes, sort=True)
    return out, len(found) if len(out) else 0


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node 0..n-1 the least node that the links connect with it."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest_of(tab: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which of the links are a maximum spanning forest of them (Boruvka's rounds; of equals the link that comes first)."""
    nodes, n = _numbered(np.concatenate([tab, tab]), np.concatenate([a, b]))
    order = np.argsort(-total, kind="stable")
    x, y = nodes[: len(a)][order], nodes[len(a) :][order]
    label, live, kept = np.arange(n), np.arange(len(order)), []
    while True:
        live = live[label[x[live]] != label[y[live]]]
        if not len(live):
            return order[np.concatenate(kept)] if kept else order
        best = np.full(n, len(order))
        for side in (x, y):
            np.minimum.at(best, label[side[live]], live)
        taken = np.unique(best[best < len(order)])
        kept.append(taken)
        label = _least_linked(n, label[x[taken]], label[y[taken]])[label]


def thinned(links: DataFrame) -> DataFrame:
    """Links that hold a maximum spanning forest of ``links`` (tab_id, a_seq, b_seq, total; whole numbers): what a task sees of
    them goes through memory in pieces, and only the forest of each piece and what is kept so far stays. Nothing is moved."""

    def run(batches):
        kept, more, n = None, [], 0

        def thin():
            table = pa.Table.from_batches(([] if kept is None else kept.to_batches()) + more).combine_chunks()
            return table.take(pa.array(forest_of(*(table.column(i).to_numpy() for i in range(4))))) if len(table) else table

        for b in batches:
            more.append(b)
            n += len(b)
            if n >= max(LINKS_AT_ONCE, 0 if kept is None else len(kept)):
                kept, more, n = thin(), [], 0
        if more:
            kept = thin()
        if kept is not None:
            yield from kept.to_batches(max_chunksize=50_000)

    return links.selectExpr("tab_id", "a_seq", "b_seq", "double(total) AS total").mapInArrow(run, _LINK)


def local_cuts(nodes: DataFrame, links: DataFrame, thresholds: list[float]) -> DataFrame:
    """cuts() for tabs that a task can hold one by one: ``nodes`` are (tab_id, seq, item), ``links`` those of thinned(). A
    task reads its tabs in order and keeps whole ones until they are enough."""
    kind = nodes.schema["item"].dataType.simpleString()
    rows = links.selectExpr("tab_id", "a_seq", "b_seq", "total", f"CAST(NULL AS {kind}) AS item").unionAll(nodes.selectExpr("tab_id", "seq", "seq", "CAST(NULL AS DOUBLE)", "item"))

    def labelled(table):
        tab, a, b, total = (table.column(i).to_numpy() for i in range(4))
        numbers, n = _numbered(np.concatenate([tab, tab]), np.concatenate([a, b]))  # in order of tab and seq, so the least is the root
        x, y = numbers[: len(a)], numbers[len(a) :]
        seq = np.zeros(n, np.int64)
        seq[x], seq[y] = a, b
        own = np.isnan(total)
        mine = table.filter(pa.array(own))
        for cut in thresholds:
            some = ~own & (np.where(own, 0.0, total) >= cut)
            root = seq[_least_linked(n, x[some], y[some])[x[own]]]
            out = pa.table({"cut": pa.array(np.full(len(mine), cut)), "tab_id": mine.column(0), "item": mine.column(4), "seq": mine.column(1), "root": pa.array(root)})
            yield from out.to_batches(max_chunksize=50_000)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if n >= LINKS_AT_ONCE and len(b):
                table = pa.Table.from_batches(held)
                tab = table.column(0).to_numpy()
                whole = int(np.searchsorted(tab, tab[-1]))  # the last tab may go on
                yield from labelled(table.slice(0, whole).combine_chunks())
                held, n = table.slice(whole).combine_chunks().to_batches(), len(tab) - whole
            held.append(b)
            n += len(b)
        if n:
            yield from labelled(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("tab_id").sortWithinPartitions("tab_id").mapInArrow(run, f"cut double, tab_id long, item {kind}, seq long, root long")


def dendrogram(items: DataFrame, thresholds: list[float], most: int = K.MAX_CLUSTERED) -> DataFrame:
    """tab_id, item, seq, cut, root: the single-linkage clusters of ``items`` (a written table) at each threshold.

    Of tabs of at most ``most`` items all pairs are scored where the tab's items meet, and no link is written or sent but those
    of a forest. Larger tabs find their pairs by index, and rounds over tables spread them over all tasks."""
    sizes = items.groupBy("tab_id").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > most).select("tab_id"))
    least = min(thresholds)
    if not large.take(1):
        return _small_tabs(items, thresholds)
    small, rest = (written(items.join(large.hint("merge"), "tab_id", how)) for how in ("left_anti", "left_semi"))
    links = written(thinned(pairs(rest, least).select("tab_id", "a_seq", "b_seq", "total")))
    far = cuts(rest.select("tab_id", "seq", "item"), spanning_forest(links), thresholds)
    return _small_tabs(small, thresholds).unionByName(far.select("cut", "tab_id", "item", "seq", "root"))


def _small_tabs(items: DataFrame, thresholds: list[float]) -> DataFrame:
    least = min(thresholds)
    a = items.select("tab_id", "seq", "item", "f")
    found = _pairs(a.alias("l"), a.alias("r"), T.at_most(F.col("l.f"), F.col("r.f")) >= least - 1e-9)
    found = found.select(F.struct("l.tab_id", "l.seq", "l.item", "l.f").alias("l"), F.struct("r.tab_id", "r.seq", "r.item", "r.f").alias("r"))
    links = thinned(scored(found, least).select("tab_id", "a_seq", "b_seq", "total"))
    return local_cuts(items.select("tab_id", "seq", "item"), links, thresholds)


def cluster(items: DataFrame, threshold: float = K.THRESHOLD, limit: int | None = K.MAX_CLUSTERED) -> DataFrame:
    """items with cluster_id (rank of the cluster in its tab: larger first, ties by first member) and cluster_size. Of a tab's
    items the first ``limit`` are clustered; the rest form one cluster of id -1 (unclustered)."""
    order = Window.partitionBy("tab_id").orderBy("seq")
    placed = items.withColumn("place", F.row_number().over(order) if limit else F.lit(0))
    shown = placed.where(F.col("place") <= limit) if limit else placed
    found, members = classes(shown)
    links = written(class_links(found, threshold))
    roots = class_roots(members, components(found.select("tab_id", "seq"), links), links)
    rooted = shown.join(written(roots.select("tab_id", "seq", "root")).hint("merge"), ["tab_id", "seq"])
    sizes = rooted.groupBy("tab_id", "root").agg(F.count("*").alias("cluster_size"))
    rank = Window.partitionBy("tab_id").orderBy(F.desc("cluster_size"), "root")
    ranked = sizes.withColumn("cluster_id", F.row_number().over(rank) - 1)
    out = rooted.join(ranked, ["tab_id", "root"]).drop("root", "place")
    if not limit:
        return out
    rest = placed.where(F.col("place") > limit)
    n = rest.groupBy("tab_id").agg(F.count("*").alias("cluster_size"))
    return out.unionByName(rest.join(n, "tab_id").withColumn("cluster_id", F.lit(-1)).drop("place"))


def mode(rows: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """Per key the most frequent value and its count; of equals the one seen first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    best = F.max_by(F.struct(F.col(value).alias("value"), F.col("n").alias("count")), F.struct("n", -F.col("first")))
    return counted.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.value").alias(value), F.col("m.count").alias(f"{value}_count"))


def describe(clusters: DataFrame, keys: tuple[str, ...] = ("tab_id", "cluster_id")) -> DataFrame:
    """A summary row per group: count, kind, dimensions, pattern, bytes, label. One pass: the values of all three modes are
    counted together, and the counts of the kinds, which every item has, add up to the group's."""
    k = list(keys)
    shown = lambda c: F.when(F.col(c) == F.floor(c), F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string"))
    kind = let(M.classify(F.col("url"), F.col("mime_type")), lambda x: F.when(x == "", "file").otherwise(x))
    dimensions = F.when((F.col("f.width") > 0) & (F.col("f.height") > 0), F.concat(shown("f.width"), F.lit("x"), shown("f.height")))
    pattern = F.when((F.col("f.pattern.dir") != "") | (F.col("f.pattern.file") != ""), F.concat(F.col("f.pattern.host"), F.col("f.pattern.dir"), F.lit("/"), F.col("f.pattern.file")))
    named = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("kind", kind), ("dimensions", dimensions), ("pattern", pattern))))
    values = clusters.select(*k, "seq", F.coalesce(F.col("bytes").cast("double"), F.lit(0.0)).alias("bytes"), F.inline(named)).where("value is not null")
    counted = values.groupBy(*k, "name", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.sum("bytes").alias("bytes"))
    of = lambda name, c: F.when(F.col("name") == name, c)
    best = lambda name: F.max_by(of(name, F.struct("value", "n")), of(name, F.struct(F.col("n"), -F.col("first")))).alias(name)
    add = lambda name, c: F.coalesce(F.sum(of(name, F.col(c))), F.lit(0))
    out = counted.groupBy(*k).agg(best("kind"), best("dimensions"), best("pattern"), add("kind", "n").alias("count"), add("kind", "bytes").cast("double").alias("bytes"), add("dimensions", "n").alias("sized"))
    major = F.coalesce(F.col("dimensions.n") * 2 > F.col("count"), F.lit(False))
    noun = F.when(F.col("kind.n") == F.col("count"), F.concat("kind.value", F.lit("s"))).otherwise("items")
    size = F.when(major, F.col("dimensions.value")).when(F.col("sized") > 0, "mixed sizes")
    label = F.concat_ws(" · ", F.concat(F.col("count").cast("string"), F.lit(" "), noun), size, F.col("pattern.value"))
    return out.select(*k, "count", F.col("kind.value").alias("kind"), F.when(major, F.col("dimensions.value")).alias("dimensions"), F.col("pattern.value").alias("pattern"), "bytes", label.alias("label"))
