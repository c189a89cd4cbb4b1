"""Candidates for a higher-resolution original of a URL, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import url as U
from lodestone.functions.core import array_of, let, lookup, text

CANDIDATE = "array<struct<url:string,verify:boolean,note:string>>"


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match only; ``$1`` and so on refer to groups, as in the pattern's own numbering."""
    java = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement.replace("\\", "\\\\"))
    lead, rest = ("", pattern[1:]) if pattern.startswith("^") else ("(?s:.*?)", pattern)
    return F.regexp_replace(c, rf"\A({lead})(?:{_end(rest)})", "$1" + java)


def _end(pattern: str) -> str:
    """``$`` matches the very end only, never before a final line end."""
    return re.sub(r"(?<!\\)\$", r"\\z", pattern)


def _with_path(p: Column, path: Column) -> Column:
    return F.concat(U.origin(p), F.when(path == "", "/").otherwise(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))), text(F.concat(F.lit("?"), p["query"])), text(F.concat(F.lit("#"), p["fragment"])))


def _join(segments: Column, name: Column) -> Column:
    return F.array_join(F.concat(segments, F.array(name)), "/")


def generic(url: Column) -> Column:
    """Ordered candidates of the seven generic rules, without repeats and without the input."""
    none = array_of([])

    def rules(x: Column) -> Column:
        p, segments, name, stem, ext = (x[c] for c in ("p", "segments", "name", "stem", "ext"))
        n = F.size(segments)
        # a rendition below /thumb/: drop that segment and the last one, and the query
        packed = F.filter(F.split(p["path"], "/"), lambda s, i: (s != "") | (i == 0))

        def rendition(all_: Column) -> Column:
            at = F.array_position(all_, "thumb")  # 1-based
            kept = F.concat(F.slice(all_, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(all_, (at + 1).cast("int"), F.greatest(F.size(all_) - at - 1, F.lit(0)).cast("int")))
            address = F.concat(U.origin(p), F.array_join(kept, "/"), text(F.concat(F.lit("#"), p["fragment"])))
            return F.when((F.instr(p["path"], "/thumb/") > 0) & (at > 0) & (F.size(all_) >= at + 3), F.array(address)).otherwise(none)

        sized = F.regexp_extract(stem, r"(?s)\A(.+?)-\d{2,5}x\d{2,5}\z", 1)
        wordpress = F.when(sized != "", F.array(_with_path(p, _join(segments, F.concat(sized, ext))))).otherwise(none)

        def without(i: Column) -> Column:
            return F.filter(segments, lambda s, j: j != i)

        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        is_transform = lambda s: s.rlike(r"(?i)\A[a-z]{1,3}_[^/]+(?:,[a-z]{1,3}_[^/]+)*\z") & s.rlike(r"(?i)(?:^|,)(?:w|h|c|q|f|dpr)_")
        transform = F.transform(F.filter(places, lambda i: is_transform(F.get(segments, i))), lambda i: _with_path(p, _join(without(i), name)))

        before = F.regexp_extract(name, r"(?s)\A(.+)=([^=]*)\z", 1)
        tail = F.regexp_extract(name, r"(?s)\A(.+)=([^=]*)\z", 2)
        suffix = F.when((before != "") & tail.rlike(r"(?i)\A[swh]\d+(?:-[a-z]+\d*)*\z"), F.array(_with_path(p, _join(segments, F.concat(before, F.lit("=s0")))), _with_path(p, _join(segments, before)))).otherwise(none)

        ends = F.get(F.filter(array_of(K.STEM_SUFFIXES), lambda s: F.endswith(F.lower(stem), s) & (F.length(stem) > F.length(s))), 0)
        base = F.substring(stem, F.lit(1), F.length(stem) - F.length(ends))
        stems = F.when(ends.isNotNull(), F.transform(array_of(K.STEM_REPLACEMENTS), lambda r: _with_path(p, _join(segments, F.concat(base, r, ext))))).otherwise(none)

        def folder(i: Column) -> Column:
            to = F.from_json(lookup(F.lower(F.get(segments, i)), {k: "[" + ",".join(f'"{v}"' for v in vs) + "]" for k, vs in K.THUMB_DIRS.items()}), "array<string>")
            swapped = F.transform(to, lambda r: _with_path(p, _join(F.transform(segments, lambda s, j: F.when(j == i, r).otherwise(s)), name)))
            return F.when(to.isNull(), none).otherwise(F.concat(swapped, F.array(_with_path(p, _join(without(i), name)))))

        folders = F.flatten(F.transform(places, folder))
        return F.concat(let(packed, rendition), wordpress, transform, suffix, stems, folders, _query(p))

    def prepared(p: Column) -> Column:
        all_ = F.split(p["path"], "/")
        name = F.element_at(all_, -1)
        return let(
            F.struct(p.alias("p"), F.slice(all_, F.lit(1), F.size(all_) - 1).alias("segments"), name.alias("name"), U.split_name(name).alias("cut")),
            lambda y: let(F.struct(y["p"].alias("p"), y["segments"].alias("segments"), y["name"].alias("name"), y["cut"]["stem"].alias("stem"), y["cut"]["ext"].alias("ext")), rules),
        )

    def pick(x: Column) -> Column:
        p, u = x["p"], x["u"]
        own = U.href(p)
        return F.when(U.is_http(p), F.filter(F.array_distinct(prepared(p)), lambda c: (c != own) & (c != u))).otherwise(none)

    return let(F.struct(U.parse(url).alias("p"), text(url).alias("u")), pick)


def _query(p: Column) -> Column:
    def rebuilt(pairs: Column) -> Column:
        query = U.join_params(pairs)
        return F.concat(U.origin(p), p["path"], F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), text(F.concat(F.lit("#"), p["fragment"])))

    def pick(ps: Column) -> Column:
        has = lambda keys: F.exists(ps, lambda q: q["k"].isin(keys))
        resize, quality, form = has(K.RESIZE_KEYS), has(K.QUALITY_KEYS), has(K.FORMAT_KEYS)
        bare = rebuilt(F.filter(ps, lambda q: ~q["k"].isin([*K.RESIZE_KEYS, *K.QUALITY_KEYS, *K.FORMAT_KEYS])))
        best = rebuilt(F.transform(ps, lambda q: F.struct(q["k"].alias("k"), F.when(q["k"].isin(K.QUALITY_KEYS), "100").otherwise(q["v"]).alias("v"))))
        plain = rebuilt(F.filter(ps, lambda q: ~q["k"].isin(K.FORMAT_KEYS)))
        out = F.array(F.when(resize | quality | form, bare), F.when(quality & resize, best), F.when(form & ~resize, plain))
        return F.filter(out, lambda c: c.isNotNull())

    return let(U.params(p), pick)


def host_matches(host: Column, match: str) -> Column:
    m = (match or "").lower()
    if not m:
        return F.lit(False)
    return F.lit(True) if m == "*" else (host == m) | F.endswith(host, F.lit("." + m))


def site(url: Column, rules: list[dict]) -> Column:
    """Candidates of declarative rules {match, path?, find, replace, verify?, note?}, in their order. Rules whose patterns do
    not compile are skipped. A replacement applies to the first match."""

    def pick(x: Column) -> Column:
        p, h = x["p"], x["h"]
        out = []
        for r in rules:
            if not r.get("find") or not isinstance(r.get("replace"), str):
                continue
            try:
                re.compile(r["find"]), re.compile(r.get("path") or "")
            except re.error:
                continue
            fits = host_matches(p["host"], r.get("match", "")) & h.rlike(_end(r["find"]))
            if r.get("path"):
                fits = fits & p["path"].rlike(_end(r["path"]))
            new = replace_first(h, r["find"], r["replace"])
            fine = fits & (new != h) & new.rlike(r"(?i)\Ahttps?://[^/?#]")
            out.append(F.when(fine, F.struct(new.alias("url"), F.lit(r.get("verify") is not False).alias("verify"), F.lit(r.get("note") or f"{r['match']} rule").alias("note"))))
        empty = F.array().cast(CANDIDATE)
        return F.filter(F.array(*out), lambda c: c.isNotNull()) if out else empty

    return let(U.parse(url), lambda p: F.when(p.isNull(), F.array().cast(CANDIDATE)).otherwise(let(F.struct(p.alias("p"), U.href(p).alias("h")), pick)))


def candidates(url: Column, rules: list[dict] | None = None) -> Column:
    """Site rules first, then the generic ones; no URL twice, never the input."""
    plain = F.transform(generic(url), lambda c: F.struct(c.alias("url"), F.lit(True).alias("verify"), F.lit("generic rule").alias("note")))
    both = F.concat(site(url, rules), plain) if rules else plain

    def unique(x: Column) -> Column:
        urls = F.transform(x, lambda c: c["url"])
        return F.filter(x, lambda c, i: (F.array_position(urls, c["url"]) == i + 1) & (c["url"] != url))

    return let(both, unique)
