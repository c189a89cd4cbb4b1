"""Paths of saved files, sizes as text, commands, and small text parsers, as Column expressions unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import url as U
from lodestone.functions.core import half_up, let, text, utf16_length
from lodestone.functions.policy import decode_or_same

TEMPLATE = "media/{host}/{title}/{index}-{basename}.{ext}"
TOKENS = ("host", "title", "date", "index", "basename", "ext", "width", "height", "group")


def clamp_units(c: Column, units: Column) -> Column:
    """At most ``units`` UTF-16 units, no character cut in two."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + utf16_length(x)
        fits = ~a["full"] & (n <= units)
        return F.struct(F.when(fits, F.concat(a["s"], x)).otherwise(a["s"]).alias("s"), F.when(fits, n).otherwise(a["n"]).alias("n"), (a["full"] | ~fits).alias("full"))

    return F.when(utf16_length(c) <= units, c).otherwise(F.aggregate(letters, zero, step, lambda a: a["s"]))


def sanitize_segment(value: Column, most: int = K.SEGMENT_MAX) -> Column:
    """A text as one path segment that every file system takes."""
    space = r"[\s\x{A0}\x{FEFF}]"
    s = F.regexp_replace(F.substring(text(value), 1, most * 4), r"[\x00-\x1F\x7F]", "")
    s = F.regexp_replace(s, r'[<>:"/\\|?*]', "_")
    s = F.trim(F.regexp_replace(s, space + "+", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\.{2,}", "."), r"\A\.+", "")
    s = F.regexp_replace(s, r"[.\s\x{A0}\x{FEFF}]+\z", "")
    named = let(s, lambda x: F.when(F.lower(F.when(F.instr(x, ".") > 0, F.regexp_extract(x, r"(?s)\A(.*)\.[^.]*\z", 1)).otherwise(x)).isin(K.WINDOWS_NAMES), F.concat(F.lit("_"), x)).otherwise(x))

    def cut(x: Column) -> Column:
        parts = r"(?s)\A(.+)(\.[^.]{0,11})\z"
        ext = F.regexp_extract(x, parts, 2)
        short = F.concat(clamp_units(F.regexp_extract(x, parts, 1), F.greatest(F.lit(1), F.lit(most) - utf16_length(ext))), ext)
        return F.when(x == "", "file").when(utf16_length(x) <= most, x).when(ext != "", short).otherwise(clamp_units(x, F.lit(most)))

    return let(named, cut)


def _segments(p: Column) -> Column:
    return F.filter(F.split(text(p["path"]), "/"), lambda s: s != "")


def basename_of(url: Column) -> Column:
    def pick(p: Column) -> Column:
        last = decode_or_same(text(F.get(_segments(p), F.size(_segments(p)) - 1)))
        stem = let(U.split_name(last), lambda x: x["stem"])
        return F.when(p.isNull(), "file").when(F.size(_segments(p)) == 0, "index").when(stem == "", "file").otherwise(stem)

    return F.when(M.is_data(url), "inline").when(M.is_blob(url), "blob").otherwise(let(U.parse(url), pick))


def resolve_extension(url: Column, mime: Column) -> Column:
    return let(F.struct(M.ext_from_mime(mime).alias("m"), M.ext_of(url).alias("u")), lambda x: F.when(x["m"] != "", x["m"]).when(x["u"] != "", x["u"]).otherwise("bin"))


def tokens(url: Column, mime: Column, width: Column, height: Column, index: Column, total: Column, page_url: Column, page_title: Column, group: Column, now: Column) -> dict[str, Column]:
    """The values of the template's tokens. now: a timestamp, shown in the session's time zone."""
    page = U.parse(text(page_url))
    own, host = text(U.parse(url)["host"]), text(page["host"])
    last = text(F.get(_segments(page), F.size(_segments(page)) - 1))
    digits = F.greatest(F.lit(3), F.length(total.cast("string")))
    number = index.cast("string")
    shown = lambda c: F.coalesce(F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string")), F.lit("0"))
    return {
        "host": F.when(own != "", own).when(host != "", host).otherwise("unknown-host"),
        "title": F.when(text(page_title) != "", page_title).when(last != "", last).otherwise("page"),
        "date": F.date_format(now, "yyyy-MM-dd"),
        "index": F.concat(F.repeat(F.lit("0"), F.greatest(digits - F.length(number), F.lit(0))), number),
        "basename": basename_of(url),
        "ext": resolve_extension(url, mime),
        "width": shown(width.cast("double")),
        "height": shown(height.cast("double")),
        "group": F.when(text(group) != "", group).otherwise("ungrouped"),
    }


def apply_template(values: dict[str, Column], template: str = TEMPLATE) -> Column:
    """The path that a template gives; separators inside values do not make folders."""
    import re

    pieces = re.split("\\{(" + "|".join(TOKENS) + ")\\}", template)
    flat = lambda c: F.regexp_replace(text(c), r"[/\\]", "_")
    expanded = F.concat(*(flat(values[x]) if i % 2 else F.lit(x) for i, x in enumerate(pieces)))
    ext = F.when(values["ext"] == "", "").otherwise(sanitize_segment(values["ext"], 12))

    def build(x: Column) -> Column:
        parts, e = x["parts"], x["ext"]
        last = F.element_at(parts, -1)
        missing = (e != "") & (e != "bin") & ~F.endswith(F.lower(last), F.concat(F.lit("."), F.lower(e)))
        named = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(sanitize_segment(F.concat(last, F.lit("."), e))))
        return F.when(F.size(parts) == 0, "media/file").otherwise(F.array_join(F.when(missing, named).otherwise(parts), "/"))

    parts = F.transform(F.filter(F.transform(F.split(expanded, "/"), lambda s: F.trim(s)), lambda s: ~s.isin("", ".", "..")), lambda s: sanitize_segment(s))
    return let(F.struct(parts.alias("parts"), ext.alias("ext")), build)


def format_bytes(size: Column) -> Column:
    v = size.cast("double")
    power = F.least(F.lit(4), F.floor(F.log2(v) / 10)).cast("int")
    power = F.when(v < 1024, 0).otherwise(F.greatest(power, F.lit(1)))
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))

    def show(x: Column) -> Column:
        n = x["v"] / F.pow(F.lit(1024.0), x["p"])
        number = F.when((n >= 100) | (x["p"] == 0), half_up(n).cast("long").cast("string")).otherwise(F.format_string("%.1f", n))
        return F.concat(number, F.lit(" "), F.get(units, x["p"]))

    fine = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v != float("inf"))
    return F.when(fine, let(F.struct(v.alias("v"), power.alias("p")), show)).otherwise("—")


def urls_from_css(css: Column) -> Column:
    found = F.regexp_extract_all(text(css), F.lit(r"""url\(\s*(?:"([^"]*)"|'([^']*)'|([^)"']*))\s*\)"""), F.lit(0))
    clean = F.transform(found, lambda u: F.trim(F.regexp_extract(u, r"""(?s)\Aurl\(\s*["']?(.*?)["']?\s*\)\z""", 1)))
    return F.filter(clean, lambda u: u != "")


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def _option(name: str, value: Column | None) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return F.when(text(value) != "", F.concat(F.lit(name + " "), shell_quote(value)))


def download_command(url: Column, format_id: Column | None = None, referer: Column | None = None, user_agent: Column | None = None, cookie: Column | None = None, browser: Column | None = None, output: Column | None = None) -> Column:
    """The yt-dlp command for a stream; a cookie header goes before cookies from a browser."""
    header = None if cookie is None else F.when(text(cookie) != "", F.concat(F.lit("Cookie: "), cookie))
    from_browser = _option("--cookies-from-browser", browser)
    if cookie is not None:
        from_browser = F.when(text(cookie) == "", from_browser)
    return F.concat_ws(" ", F.lit("yt-dlp"), _option("-f", format_id), _option("--referer", referer), _option("--user-agent", user_agent), _option("--add-header", header), from_browser, _option("-o", output), shell_quote(url))


def remux_command(url: Column, referer: Column | None = None, user_agent: Column | None = None, cookie: Column | None = None, output: Column | None = None) -> Column:
    """The ffmpeg command that copies a stream into a file."""
    lines = [F.when(text(v) != "", F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))) for k, v in (("Referer", referer), ("Cookie", cookie)) if v is not None]
    headers = F.concat_ws("", *lines) if lines else None
    target = F.lit("out.mp4") if output is None else F.when(text(output) != "", output).otherwise("out.mp4")
    return F.concat_ws(" ", F.lit("ffmpeg"), _option("-user_agent", user_agent), _option("-headers", headers), F.concat(F.lit("-i "), shell_quote(url)), F.lit("-c copy"), shell_quote(target))


def parse_srcset(srcset: str) -> list[tuple[str, str]]:
    """(url, descriptor) of each entry, in plain Python: a URL runs to white space, a comma at its end means that it has no
    descriptor, and a descriptor runs to the next comma outside parentheses."""
    out, i, n, space = [], 0, len(srcset), " \t\n\r\f"
    while True:
        while i < n and (srcset[i] in space or srcset[i] == ","):
            i += 1
        if i >= n:
            return out
        j = next((k for k in range(i, n) if srcset[k] in space), n)
        address, i = srcset[i:j], j
        if address.endswith(","):
            if address := address.rstrip(","):
                out.append((address, ""))
            continue
        depth, j = 0, i
        while j < n and not (srcset[j] == "," and depth == 0):
            depth = depth + 1 if srcset[j] == "(" else max(0, depth - 1) if srcset[j] == ")" else depth
            j += 1
        out.append((address, srcset[i:j].strip(space)))
        i = j + 1


def best_of_srcset(srcset: str | None) -> str:
    """The widest entry; a density counts a thousandth of a width, no descriptor is 1x, and of equals the first is taken."""
    import re

    best, top = "", -1.0
    for address, descriptor in parse_srcset(srcset or ""):
        m = re.fullmatch(r"(\d+(?:\.\d+)?)([wx])", descriptor, re.I)
        value = 1e-3 if m is None else float(m[1]) * (1.0 if m[2] in "wW" else 1e-3)
        if value > top:
            best, top = address, value
    return best


