"""URL functions as Column expressions: resolution, dedupe key, shape, expiry.

A URL is parsed once into a struct (scheme, host, port, path, query, fragment; null if it has no absolute form), in the
subset of the WHATWG rules that web evidence needs: relative references, dot segments, back slashes, default ports,
lower-cased hosts (hosts.ascii_url puts names of other scripts and addresses in numbers into the browser's form first),
percent-encoding of what may not stand in a path. Paths end before ``?``; query and fragment are
without their marks and null where absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.core import array_of, let, number, text

PARTS = "struct<scheme:string,host:string,port:string,path:string,query:string,fragment:string>"
_SAFE_PATH = r"\A[!$-;=@-Z\[\]_a-z|~\\]*\z"
_SAFE_QUERY = r"\A[!$-;=?-Z\[-`a-z{-~]*\z"


def _encode(c: Column, safe: str, keep: str) -> Column:
    """Percent-encodes all but the characters of ``keep``; most texts match ``safe`` and stay as they are."""
    one = lambda x: F.when(x.rlike(keep), x).when(x == " ", "%20").otherwise(F.url_encode(x))
    return F.when(c.rlike(safe), c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def _no_dots(path: Column) -> Column:
    """The path without dot segments; it starts with a slash."""
    dots = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|\z)"

    def fold(segments: Column) -> Column:
        up, same = r"(?i)\A(?:\.|%2e){2}\z", r"(?i)\A(?:\.|%2e)\z"
        step = lambda a, s: F.when(s.rlike(up), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s.rlike(same), a).otherwise(F.concat(a, F.array(s)))
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        tail = F.element_at(segments, -1).rlike(up) | F.element_at(segments, -1).rlike(same)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(tail & (F.size(kept) > 0), "/").otherwise(""))

    return F.when(path.rlike(dots), let(F.slice(F.split(path, "/"), 2, 100_000), fold)).otherwise(path)


def parse(raw: Column, base: Column | None = None) -> Column:
    """The parts of ``raw`` resolved against ``base``; null if there is no absolute form. Non-http schemes keep their rest as path."""

    def absolute(u: Column) -> Column:
        return let(F.struct(u.alias("u"), F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme")), by_scheme)

    def by_scheme(x: Column) -> Column:
        u, scheme = x["u"], x["scheme"]
        other = F.struct(
            scheme.alias("scheme"), F.lit("").alias("host"), F.lit("").alias("port"),
            F.regexp_extract(u, r"(?s)\A[^:]*:([^?#]*)", 1).alias("path"),
            F.when(u.rlike(r"(?s)\A[^#]*\?"), F.regexp_extract(u, r"(?s)\?([^#]*)", 1)).alias("query"),
            F.when(u.contains("#"), F.regexp_extract(u, r"(?s)#(.*)\z", 1)).alias("fragment"),
        )
        rest = F.regexp_extract(u, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*:[/\\]*(.*)\z", 1)
        return F.when(scheme.isin("http", "https"), let(F.struct(scheme.alias("scheme"), rest.alias("rest"), F.regexp_extract(rest, r"\A([^/\\?#]*)", 1).alias("authority")), http)).when(scheme != "", other)

    def http(x: Column) -> Column:
        scheme, rest, authority = x["scheme"], x["rest"], x["authority"]
        path = F.replace(F.regexp_extract(rest, r"(?s)\A[^/\\?#]*([^?#]*)", 1), F.lit("\\"), F.lit("/"))
        query = F.when(rest.rlike(r"(?s)\A[^?#]*\?"), let(F.regexp_extract(rest, r"(?s)\A[^?#]*\?([^#]*)", 1), lambda q: _encode(q, _SAFE_QUERY, r"\A[!$-;=?-Z\[-`a-z{-~]\z")))
        parts = F.struct(
            scheme.alias("scheme"),
            F.lower(F.regexp_replace(F.regexp_replace(authority, r"\A.*@", ""), r":\d*\z", "")).alias("host"),
            F.regexp_extract(authority, r":(\d+)\z", 1).alias("port"),
            let(path, lambda y: F.when(y == "", "/").otherwise(let(_encode(y, _SAFE_PATH, r"\A[!$-;=@-Z\[\]_a-z|~\\]\z"), _no_dots))).alias("path"),
            query.alias("query"),
            F.when(rest.contains("#"), F.regexp_extract(rest, r"(?s)#(.*)\z", 1)).alias("fragment"),
        )
        default = F.when(scheme == "https", "443").otherwise("80")
        fine = lambda y: F.when((y["host"] != "") & (~y["host"].rlike(r"[\s<>^|%\[\]]") | y["host"].rlike(r"\A\[[0-9a-f:.]+\]\z")), F.struct(*(F.when(y["port"] != default, y["port"]).otherwise("").alias("port") if c == "port" else y[c].alias(c) for c in ("scheme", "host", "port", "path", "query", "fragment"))))
        return let(parts, fine)

    clean = F.regexp_replace(F.btrim(raw, F.lit(" \t\n\r\x0b\x0c")), r"[\t\n\r]", "")
    if base is None:
        return let(F.when(clean.startswith("//"), F.concat(F.lit("https:"), clean)).otherwise(clean), lambda u: F.when(u != "", absolute(u)))

    def against(u: Column, b: Column) -> Column:
        origin = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]*)", 1)
        path = F.regexp_extract(b, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]*([^?#]*)", 1)
        query = F.regexp_extract(b, r"\A[^#?]*(\?[^#]*)?", 1)
        folder = F.regexp_replace(path, r"[^/]*\z", "")
        joined = (
            F.when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .when(u.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), u)
            .when(origin == "", None)
            .when(u.startswith("/"), F.concat(origin, u))
            .when(u.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), u))
            .when(u.startswith("#") | (u == ""), F.concat(origin, F.when(path == "", "/").otherwise(path), query, u))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), u))
        )
        return let(joined, lambda x: F.when(x.isNotNull(), absolute(x)))

    return let(F.struct(clean.alias("u"), text(base).alias("b")), lambda x: F.when(x["u"] != "", against(x["u"], x["b"])))


def is_http(p: Column) -> Column:
    return F.coalesce(p["scheme"].isin("http", "https"), F.lit(False))


def origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"])))


def href(p: Column, with_fragment: bool = True) -> Column:
    """The text of a parsed URL."""
    start = F.when(is_http(p), origin(p)).otherwise(F.concat(p["scheme"], F.lit(":")))
    out = F.concat(start, p["path"], text(F.concat(F.lit("?"), p["query"])))
    return F.concat(out, text(F.concat(F.lit("#"), p["fragment"]))) if with_fragment else out


#: A reference without scheme, query, fragment, dot segments or characters to encode: it is appended to its base's folder as it is.
_PLAIN = r"\A[A-Za-z0-9_~-][A-Za-z0-9_~,.-]*(?:/(?!\.{1,2}(?:/|\z))[A-Za-z0-9_~,.-]*)*\z"


def folder_of(base: Column) -> Column:
    """What a plain reference is appended to; null if nothing can be resolved against ``base``."""
    return let(let(parse(F.lit("x"), base), lambda p: href(p)), lambda u: F.substring(u, F.lit(1), F.length(u) - 1))


def resolved(raw: Column, base: Column, folder: Column) -> Column:
    """``raw`` resolved against ``base``, whose folder_of() is at hand; as it is if it cannot be resolved."""
    return F.when(folder.isNotNull() & raw.rlike(_PLAIN), F.concat(folder, raw)).otherwise(F.coalesce(let(parse(raw, base), lambda p: href(p)), raw))


def decode_form(c: Column) -> Column:
    """A form value decoded: plus is a space; what cannot be decoded stays."""
    return F.when(c.rlike("[%+]"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)


def params(p: Column) -> Column:
    """The query's parameters as (k, v), in order, decoded."""
    pair = lambda s: F.struct(decode_form(F.substring_index(s, "=", 1)).alias("k"), decode_form(F.when(F.instr(s, "=") > 0, F.regexp_extract(s, r"(?s)\A[^=]*=(.*)\z", 1)).otherwise("")).alias("v"))
    return F.transform(F.filter(F.split(text(p["query"]), "&"), lambda s: s != ""), pair)


def encode_form(c: Column) -> Column:
    return F.when(c.rlike(r"\A[A-Za-z0-9*._-]*\z"), c).otherwise(F.url_encode(c))


def join_params(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda x: F.concat(encode_form(x["k"]), F.lit("="), encode_form(x["v"]))), "&")


def is_tracking(key: Column) -> Column:
    """Whether a lower-cased key only tracks."""
    prefixed = key.startswith(K.TRACKING_PREFIXES[0]) | key.startswith(K.TRACKING_PREFIXES[1])
    return key.isin(K.TRACKING_KEYS) | (prefixed & ~key.isin(K.AUTH_KEYS_LIKE_TRACKING))


def normalize_url(raw: Column, base: Column | None = None) -> Column:
    """The dedupe key of a URL."""

    def key(x: Column) -> Column:
        p = x["p"]
        lower = F.transform(params(p), lambda q: F.struct(F.lower(q["k"]).alias("k"), q["v"].alias("v")))
        kept = F.array_sort(F.filter(lower, lambda q: ~is_tracking(q["k"])))
        path = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], r"/\z", "")).otherwise(p["path"])
        query = F.when(p["query"].isNull(), "").otherwise(let(join_params(kept), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
        return F.when(x["t"].rlike(r"\A(?:data|blob):") | (x["t"] == ""), x["t"]).when(p.isNull(), x["t"]).when(~is_http(p), href(p)).otherwise(F.concat(origin(p), path, query))

    trimmed = F.btrim(text(raw), F.lit(" \t\n\r\x0b\x0c"))
    return let(F.struct(trimmed.alias("t"), parse(trimmed, base).alias("p")), key)


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(host)), r":\d+\z", ""), r"\A(?:www\d*|m|mobile|amp)\.", "")


def registrable_domain(host: Column) -> Column:
    def pick(parts: Column) -> Column:
        n = F.size(parts)
        second = F.get(parts, n - 2)
        return F.when(n <= 2, F.array_join(parts, ".")).when(second.isin(K.SECOND_LEVEL), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))

    return let(F.filter(F.split(bare_host(host), r"\."), lambda x: x != ""), pick)


_HEXISH, _BASEISH, _DIGITS = r"\A[0-9a-fA-F]{8,}\z", r"\A[A-Za-z0-9_-]{12,}\z", r"\A\d+\z"


def _opaque(c: Column) -> Column:
    return c.rlike(_BASEISH) & c.rlike(r"\d") & c.rlike("[A-Za-z]")


def generic_segment(segment: Column) -> Column:
    return F.when(segment.rlike(_DIGITS) | segment.rlike(_HEXISH) | _opaque(segment), "*").otherwise(F.lower(segment))


def split_name(name: Column) -> Column:
    """(stem, ext with its dot) at the last dot that is not the first character."""
    at = r"(?s)\A(.+)\.([^.]*)\z"
    return F.when(name.rlike(at), F.struct(F.regexp_extract(name, at, 1).alias("stem"), F.concat(F.lit("."), F.regexp_extract(name, at, 2)).alias("ext"))).otherwise(F.struct(name.alias("stem"), F.lit("").alias("ext")))


def generic_filename(name: Column) -> Column:
    def shape(x: Column) -> Column:
        stem, ext = x["stem"], F.lower(F.substring(x["ext"], 2, 1000))
        out = F.when(stem.rlike(_HEXISH) | (_opaque(stem) & ~stem.rlike("[-_]")), "*").otherwise(F.regexp_replace(F.lower(stem), r"\d+", "#"))
        return F.when(ext == "", out).otherwise(F.concat(out, F.lit("."), ext))

    return F.when(name == "", "").otherwise(let(split_name(name), shape))


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(text(path)), r"[/\-_.]+"), lambda t: (t != "") & ~t.rlike(_DIGITS) & ~t.rlike(_HEXISH))


def size_key(p: Column) -> Column:
    keyed = F.filter(F.transform(params(p), lambda q: F.struct(F.lower(q["k"]).alias("k"), q["v"].alias("v"))), lambda q: q["k"].isin(K.SIZE_KEYS))
    return F.array_join(F.array_sort(F.transform(keyed, lambda q: F.concat(q["k"], F.lit("="), q["v"]))), "&")


def pattern_of(raw: Column, base: Column | None = None) -> Column:
    """host, bare, domain, dir, file, ext, pattern, tokens, sizeKey of a URL."""
    fields = ("host", "bare", "domain", "dir", "file", "ext", "pattern", "tokens", "sizeKey")

    def of(**values) -> Column:
        return F.struct(*(values.get(f, array_of([]) if f == "tokens" else F.lit("")).alias(f) for f in fields))

    def http(p: Column) -> Column:
        def shape(x: Column) -> Column:
            segments = x["segments"]
            n = F.size(segments)
            folder = F.concat(F.lit("/"), F.array_join(F.transform(F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0))), generic_segment), "/"))
            name = generic_filename(text(F.get(segments, n - 1)))
            return let(
                F.struct(folder.alias("dir"), name.alias("file")),
                lambda y: of(
                    host=p["host"], bare=bare_host(p["host"]), domain=registrable_domain(p["host"]), dir=y["dir"], file=y["file"],
                    ext=F.when(F.instr(y["file"], ".") > 0, F.substring_index(y["file"], ".", -1)).otherwise(""),
                    pattern=F.concat(y["dir"], F.lit("/"), y["file"]), tokens=path_tokens(p["path"]), sizeKey=size_key(p),
                ),
            )

        return let(F.struct(F.filter(F.split(p["path"], "/"), lambda s: s != "").alias("segments")), shape)

    def pick(x: Column) -> Column:
        p, t = x["p"], x["t"]
        inline, scheme = F.substring(t, 1, 5), F.concat(p["scheme"], F.lit(":"))
        return (
            F.when(t.rlike(r"\A(?:data|blob):"), of(host=inline, bare=inline, pattern=inline))
            .when(p.isNull(), of())
            .when(~is_http(p), of(host=scheme, bare=scheme, pattern=scheme))
            .otherwise(http(p))
        )

    return let(F.struct(text(raw).alias("t"), parse(text(raw), base).alias("p")), pick)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def expiry(raw: Column, now_ms: Column) -> Column:
    """(expiring, expires_at in epoch ms or null). ``now_ms`` is a parameter so that results repeat."""
    none = F.lit(None).cast("long")
    result = lambda flag, at: F.struct(F.lit(flag).alias("expiring"), at.cast("long").alias("expires_at"))

    def pick(ps: Column) -> Column:
        first = lambda key: F.get(F.transform(F.filter(ps, lambda q: q["k"] == key), lambda q: q["v"]), 0)  # noqa: E731  (an empty first value hides later ones)
        either = lambda x, y: F.nullif(F.coalesce(F.nullif(first(x), F.lit("")), first(y)), F.lit(""))
        date = either("X-Amz-Date", "x-amz-date")
        start = F.unix_millis(F.try_to_timestamp(date, F.lit("yyyyMMdd'T'HHmmss'Z'")))
        stamped = date.rlike(r"\A\d{8}T\d{6}Z\z")
        lasts = either("X-Amz-Expires", "x-amz-expires")

        def deadline(v: Column) -> Column:
            n = number(v)
            iso = F.unix_millis(F.coalesce(v.try_cast("timestamp"), F.try_to_timestamp(F.regexp_replace(v, r"\A[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))))
            seconds = F.when(v.rlike(r"\A[0-9a-fA-F]{8}\z"), F.conv(v, 16, 10).cast("double"))
            return (
                F.when((n > 1e9) & (n < 1e11), n * 1000)
                .when((n >= 1e12) & (n < 1e14), n)
                .when(iso > now_ms - 31_500_000_000, iso)
                .when((seconds > 1e9) & (seconds < 1e11), seconds * 1000)
            )

        found = F.coalesce(*(deadline(first(k)) for k in K.EXPIRY_KEYS))
        signed = F.exists(ps, lambda q: q["k"].isin(K.SIGNED_KEYS))
        return (
            F.when(F.coalesce(stamped, F.lit(False)) & lasts.isNotNull() & start.isNotNull(), result(True, start + number(lasts) * 1000))
            .when(found.isNotNull(), result(True, found))
            .when(signed, result(True, none))
            .otherwise(result(False, none))
        )

    return let(F.coalesce(params(parse(text(raw))), F.array().cast("array<struct<k:string,v:string>>")), pick)


def crawl_key(raw: Column, base: Column) -> Column:
    """The resolved address without its fragment; empty if it cannot be resolved."""
    return let(parse(raw, base), lambda p: F.when(p.isNull(), "").otherwise(href(p, with_fragment=False)))


def host_of(raw: Column) -> Column:
    """Host with port, by which downloads queue."""
    return let(parse(raw), lambda p: F.when(p.isNull(), "unknown").otherwise(F.concat(p["host"], F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"])))))
