"""Class hygiene and the five similarity terms, as Column expressions over precomputed features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import url as U
from lodestone.functions.core import array_of, let, text

PATH = "array<struct<tag:string,classes:array<string>>>"


def class_entropy(token: Column) -> Column:
    """Shannon bits of the letters and digits, more for mixed case, digits and few vowels; 0 for fewer than four."""

    def bits(s: Column) -> Column:
        n = F.length(s)
        letters = F.filter(F.split(s, ""), lambda x: x != "")
        each = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
        shannon = F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))
        vowels = F.regexp_count(s, F.lit("(?i)[aeiou]")) / n
        mixed = F.when(s.rlike("[a-z]") & s.rlike("[A-Z]"), 0.6).otherwise(0.0)
        digit = F.when(s.rlike(r"\d"), 0.6).otherwise(0.0)
        return F.when(n < 4, 0.0).otherwise(shannon + mixed + digit + F.greatest(F.lit(0.0), 0.35 - vowels) * 2)

    return let(F.regexp_replace(text(token), "[^A-Za-z0-9]", ""), bits)


def has_hash_signal(token: Column) -> Column:
    """Whether a class name looks generated."""
    tail = F.element_at(F.concat(array_of([""]), F.filter(F.split(token, "[-_]"), lambda x: x != "")), -1)

    def signal(t: Column) -> Column:
        mixed = (F.length(t) >= 5) & t.rlike(r"\d") & t.rlike("[a-z]") & t.rlike("[A-Z]")
        shaped = token.rlike(r"\A[A-Za-z]+[-_][A-Za-z0-9]{5,}\z") & (F.length(t) >= 6) & t.rlike(r"\d")
        return token.rlike(r"\A(?:css-[a-z0-9]+|sc-[A-Za-z0-9]+)\z") | (token.rlike("(?i)[0-9a-f]{6,}") & token.rlike(r"\d")) | mixed | shaped

    return let(tail, signal)


def strip_dynamic_classes(classes: Column, counts: Column | None = None) -> Column:
    """The class names that tell something, lower-cased and sorted. With a count, rare and random names go; without, names
    that look generated."""
    tokens = F.filter(F.transform(F.coalesce(classes, array_of([])), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "") & ~t.rlike(K.STATE_CLASS))

    def dynamic(t: Column) -> Column:
        if counts is None:
            return has_hash_signal(t)
        n = F.try_element_at(counts, t)
        return F.when(n.isNull(), has_hash_signal(t)).otherwise((n <= K.MAX_DYNAMIC_FREQUENCY) & (class_entropy(t) >= K.ENTROPY_THRESHOLD))

    return F.array_sort(F.transform(F.filter(tokens, lambda t: ~dynamic(t)), F.lower))


def normalize_path(path: Column, counts: Column | None = None) -> Column:
    node = lambda x: F.struct(F.lower(text(x["tag"])).alias("tag"), strip_dynamic_classes(x["classes"], counts).alias("classes"))
    return F.transform(F.coalesce(path, F.array().cast(PATH)), node)


def repeat_key(path: Column, in_group: Column, depth: Column) -> Column:
    """Identity of the repeated group that an element is in: empty if in none, ``*`` if it is not known which."""
    size = F.size(path)
    known = depth.isNotNull() & (depth >= 0) & (depth < size)
    nodes = F.transform(F.slice(path, F.when(known, depth + 1).otherwise(1), F.greatest(size, F.lit(1))), lambda x: F.concat(x["tag"], F.lit("."), F.array_join(x["classes"], ".")))
    return F.when(~F.coalesce(in_group, F.lit(False)), "").when(~known, "*").otherwise(F.array_join(nodes, ">"))


def effective_mime(url: Column, mime: Column) -> Column:
    kind, ext = M.classify(url, mime), M.ext_of(url)
    derived = F.when((kind != "") & (ext != ""), F.concat(kind, F.lit("/"), ext)).when(kind != "", F.concat(kind, F.lit("/*"))).otherwise("")
    return F.when(text(mime) != "", mime).otherwise(derived)


def features(url: Column, mime: Column, width: Column, height: Column, path: Column | None = None, counts: Column | None = None, in_group: Column | None = None, depth: Column | None = None) -> Column:
    """All that the terms need of one item, computed once: pattern, path from the root, repeat key, dimensions, type."""
    cleaned = normalize_path(path, counts) if path is not None else F.array().cast(PATH)
    in_group = F.lit(False) if in_group is None else in_group
    depth = F.lit(-1) if depth is None else depth
    mime_type = effective_mime(url, mime)
    return let(
        F.struct(cleaned.alias("path"), mime_type.alias("mime")),
        lambda x: F.struct(
            U.pattern_of(url).alias("pattern"),
            F.transform(F.reverse(x["path"]), lambda n: F.concat(n["tag"], F.lit(" "), F.array_join(n["classes"], " "))).alias("root"),
            repeat_key(x["path"], in_group, depth).alias("key"),
            F.coalesce(width.cast("double"), F.lit(0.0)).alias("width"),
            F.coalesce(height.cast("double"), F.lit(0.0)).alias("height"),
            F.when(x["mime"] != "", M.mime_subtype(x["mime"])).otherwise("").alias("subtype"),
            F.when(x["mime"] != "", M.mime_top_level(x["mime"])).otherwise("").alias("top"),
            (x["mime"] != "").alias("typed"),
        ),
    )


def url_similarity(a: Column, b: Column) -> Column:
    a, b = a["pattern"], b["pattern"]
    host = (a["bare"] == b["bare"]) & (a["bare"] != "")
    ext = (a["ext"] == b["ext"]) & (a["ext"] != "")
    return (
        F.when((a["host"] == "") & (b["host"] == ""), 0.0)
        .when(host & (a["pattern"] == b["pattern"]) & (a["pattern"] != ""), 1.0)
        .when(host & ext & (a["dir"] == b["dir"]), 0.75)
        .when(host & ext, 0.4)
        .otherwise(F.least(F.lit(0.35), U.jaccard(a["tokens"], b["tokens"])))
    )


def structure_similarity(a: Column, b: Column) -> Column:
    ra, rb, ka, kb = a["root"], b["root"], a["key"], b["key"]
    na, nb = F.size(ra), F.size(rb)
    # the first place where the paths part, from the root
    parts = F.array_position(F.transform(F.arrays_zip(ra.alias("x"), rb.alias("y")), lambda z: ~F.equal_null(z["x"], z["y"])), True)
    common = F.when(parts == 0, F.least(na, nb)).otherwise(parts - 1)

    def value(c: Column) -> Column:
        score = c / F.greatest(na, nb)
        keyed = (ka != "") | (kb != "")
        same = F.when((ka != "") & (kb != ""), (ka == kb) | (ka == "*") | (kb == "*")).otherwise(score == 1)
        near = (c > 0) & (na - c <= 4) & (nb - c <= 4)
        return F.when(keyed & ~same, 0.0).when(keyed & near, F.least(F.lit(1.0), score + 0.15)).otherwise(score)

    return F.when((na == 0) | (nb == 0), K.NEUTRAL).otherwise(let(common, value))


def dimension_similarity(a: Column, b: Column) -> Column:
    known = (a["width"] > 0) & (a["height"] > 0) & (b["width"] > 0) & (b["height"] > 0)
    area_a, area_b = a["width"] * a["height"], b["width"] * b["height"]
    ratio = F.least(area_a, area_b) / F.greatest(area_a, area_b)
    shape_a, shape_b = a["width"] / a["height"], b["width"] / b["height"]
    delta = F.abs(shape_a - shape_b) / F.greatest(shape_a, shape_b)
    return F.when(known, 0.5 * ratio + 0.5 * (1 - F.least(delta, F.lit(1.0)))).otherwise(0.5)


def type_similarity(a: Column, b: Column) -> Column:
    same = (a["subtype"] != "") & (a["subtype"] == b["subtype"]) & (a["subtype"] != "*")
    top = (a["top"] != "") & (a["top"] == b["top"])
    return F.when(~a["typed"] | ~b["typed"], 0.0).when(same, 1.0).when(top, 0.6).otherwise(0.0)


def host_similarity(a: Column, b: Column) -> Column:
    a, b = a["pattern"], b["pattern"]
    return F.when((a["host"] == "") | (b["host"] == ""), 0.0).when((a["host"] == b["host"]) | (a["bare"] == b["bare"]), 1.0).when(_domain(a) == _domain(b), 0.7).otherwise(0.0)


def _domain(p: Column) -> Column:
    """Inline and opaque schemes have no domain of their own; their host stands in."""
    return F.when(p["domain"] == "", p["bare"]).otherwise(p["domain"])


TERMS = {"url": url_similarity, "structure": structure_similarity, "dimension": dimension_similarity, "type": type_similarity, "host": host_similarity}


def each(a: Column, b: Column) -> Column:
    """The five terms."""
    return F.struct(*(f(a, b).alias(name) for name, f in TERMS.items()))


def explain(a: Column, b: Column) -> Column:
    """The five terms and their weighted total."""
    return let(each(a, b), lambda t: F.struct(*(t[n].alias(n) for n in TERMS), total(t).alias("total")))


def at_most(a: Column, b: Column) -> Column:
    """A bound of the total that needs no arrays: unless hosts and extensions agree, URLs give 0.35 at most, and structure
    gives its neutral value where a path is missing."""
    x, y = a["pattern"], b["pattern"]
    alike = (x["bare"] == y["bare"]) & (x["bare"] != "") & ((x["ext"] == y["ext"]) | (x["pattern"] == y["pattern"]))
    url = F.when(alike, F.when(x["pattern"] == y["pattern"], 1.0).when(x["dir"] == y["dir"], 0.75).otherwise(0.4)).otherwise(0.35)
    structure = F.when((F.size(a["root"]) == 0) | (F.size(b["root"]) == 0), K.NEUTRAL).otherwise(1.0)
    return total({"url": url, "structure": structure, "dimension": dimension_similarity(a, b), "type": type_similarity(a, b), "host": host_similarity(a, b)})


def total(t: Column) -> Column:
    w = K.WEIGHTS
    return w["url"] * t["url"] + w["structure"] * t["structure"] + w["dimension"] * t["dimension"] + w["type"] * t["type"] + w["host"] * t["host"]


def score(a: Column, b: Column) -> Column:
    return total({name: f(a, b) for name, f in TERMS.items()})  # no lambda, whose body Spark would interpret
