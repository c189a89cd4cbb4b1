"""Stream manifests: HLS playlists and DASH descriptions to variants, tracks and segments. Protection is only marked.

A playlist is an array of lines, and expressions over that array make the result, in time that grows with its lines; playlists
are handled in the JVM and their lines are neither shuffled nor sorted.
A DASH description is read as a stream of XML events with the attributes of the enclosing element at hand.

A null, empty or malformed body gives an empty description, as does XML that declares entities. An address that cannot be
resolved stays as it is written.
"""

from __future__ import annotations

import re
from itertools import accumulate
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import url as U
from lodestone.functions.core import half_up, let, number, text
from lodestone.functions.paths import format_bytes
from lodestone.sources.pieces import pieces

_VARIANT = "struct<id:string,bandwidth:double,resolution:string,codecs:string,frame_rate:double,group:string,mime_type:string,lang:string,url:string>"
_TRACK = "struct<type:string,name:string,language:string,group:string,url:string,is_default:boolean>"
STREAM = f"struct<type:string,master:boolean,variants:array<{_VARIANT}>,audio_tracks:array<{_TRACK}>,subtitle_tracks:array<{_TRACK}>,segments:array<string>,duration:double,live:boolean,encrypted:boolean,encryption_method:string,key_systems:array<string>>"
_PA_VARIANT = pa.struct([("id", pa.string()), ("bandwidth", pa.float64()), ("resolution", pa.string()), ("codecs", pa.string()), ("frame_rate", pa.float64()), ("group", pa.string()), ("mime_type", pa.string()), ("lang", pa.string()), ("url", pa.string())])
_PA_TRACK = pa.struct([("type", pa.string()), ("name", pa.string()), ("language", pa.string()), ("group", pa.string()), ("url", pa.string()), ("is_default", pa.bool_())])
_PA_STREAM = pa.struct([
    ("type", pa.string()), ("master", pa.bool_()), ("variants", pa.list_(_PA_VARIANT)), ("audio_tracks", pa.list_(_PA_TRACK)), ("subtitle_tracks", pa.list_(_PA_TRACK)), ("segments", pa.list_(pa.string())),
    ("duration", pa.float64()), ("live", pa.bool_()), ("encrypted", pa.bool_()), ("encryption_method", pa.string()), ("key_systems", pa.list_(pa.string())),
])
_SPACE = " \t\n\r\x0b\x0c\u00a0\ufeff"

# ---------------------------------------------------------------- HLS

_PAIR = r'(?s)([^=]*)=(?:"([^"]*)(?:"|\z).?|([^,]*),?)'


def attributes(rest: Column) -> Column:
    """(k, v) of a tag's KEY=VALUE list; a quoted value may hold commas and may lack its closing quote."""
    part = lambda i: F.regexp_extract_all(rest, F.lit(_PAIR), F.lit(i))
    made = F.zip_with(part(1), F.zip_with(part(2), part(3), lambda q, p: F.concat(q, p)), lambda k, v: F.struct(F.upper(F.btrim(k, F.lit(_SPACE))).alias("k"), F.btrim(v, F.lit(_SPACE)).alias("v")))
    return F.filter(made, lambda x: x["k"] != "")


def attribute(pairs: Column, name: str) -> Column:
    """The value of ``name``, the last of several; empty if there is none."""
    found = F.filter(pairs, lambda x: x["k"] == name)
    return text(F.get(found, F.size(found) - 1)["v"])


def _named_systems(key_format: Column) -> Column:
    """The protection systems that a key format names, in the order of the table."""
    low = F.lower(key_format)
    known = [F.when(low.contains(mark), F.lit(name)) for mark, name in K.KEY_SYSTEMS.items()]
    return F.array_compact(F.array(*known, F.when(low.contains("widevine"), F.lit("widevine"))))


def hls_stream(url: Column, body: Column) -> Column:
    """An HLS playlist as STREAM. A body that is no playlist counts as one empty line.

    All is filters and maps over the array of a playlist's lines, so its rows are neither multiplied nor moved. Of addresses
    and stream tags alone, the tag that describes an address is the one right before it.
    """
    is_tag = lambda line, *names: F.greatest(*(line.startswith(n + ":") for n in names)) if len(names) > 1 else line.startswith(names[0] + ":")
    rest = lambda line: F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)
    resolved = lambda folder, link: U.resolved(link, url, folder)
    linked = lambda folder, a: let(attribute(a, "URI"), lambda link: F.when(link != "", resolved(folder, link)))
    is_address = lambda line: (line != "") & ~line.startswith("#")
    mark = "#EXT-X-STREAM-INF"

    def variant(folder: Column, x: Column) -> Column:
        of = lambda name: attribute(x["a"], name)
        rate = lambda name: F.nullif(F.coalesce(number(of(name)), F.lit(0.0)), F.lit(0.0))
        return F.struct(
            F.lit("").alias("id"), F.coalesce(rate("BANDWIDTH"), rate("AVERAGE-BANDWIDTH"), F.lit(0.0)).alias("bandwidth"), of("RESOLUTION").alias("resolution"), of("CODECS").alias("codecs"),
            F.coalesce(number(of("FRAME-RATE")), F.lit(0.0)).alias("frame_rate"), of("AUDIO").alias("group"), F.lit("").alias("mime_type"), F.lit("").alias("lang"), resolved(folder, x["address"]).alias("url"),
        )

    def track(folder: Column, a: Column) -> Column:
        at = lambda name: attribute(a, name)
        return F.struct(F.lower(at("TYPE")).alias("type"), at("NAME").alias("name"), at("LANGUAGE").alias("language"), at("GROUP-ID").alias("group"), text(linked(folder, a)).alias("url"), (at("DEFAULT") == "YES").alias("is_default"))

    def key(a: Column) -> Column:
        # fails closed: a key tag without a method, or with NONE and yet a key, counts as encrypted
        method = F.upper(attribute(a, "METHOD"))
        locked = (method != "NONE") | (attribute(a, "URI") != "") | (attribute(a, "KEYFORMAT") != "")
        return F.when(locked, F.struct(method.alias("method"), _named_systems(attribute(a, "KEYFORMAT")).alias("systems")))

    def lines(y: Column) -> Column:
        x, folder = y["lines"], y["folder"]
        tags = lambda *names: F.transform(F.filter(x, lambda line: is_tag(line, *names)), lambda line: attributes(rest(line)))
        seconds = F.transform(F.filter(x, lambda line: is_tag(line, "#EXTINF")), lambda line: number(F.regexp_extract(rest(line), r"\A\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)))
        return F.struct(
            folder.alias("folder"), F.filter(x, lambda line: is_address(line) | (F.substring_index(line, ":", 1) == mark)).alias("places"),
            F.transform(tags("#EXT-X-MEDIA"), lambda a: track(folder, a)).alias("tracks"), F.array_compact(F.transform(tags("#EXT-X-MAP"), lambda a: linked(folder, a))).alias("maps"),
            F.array_compact(F.transform(tags("#EXT-X-KEY", "#EXT-X-SESSION-KEY"), key)).alias("keys"), F.aggregate(F.array_compact(seconds), F.lit(0.0), lambda a, v: a + v).alias("duration"),
            F.exists(x, lambda line: line.startswith("#EXT-X-ENDLIST")).alias("ended"), F.exists(x, lambda line: line.startswith("#EXT-X-TARGETDURATION")).alias("timed"),
        )

    def paired(x: Column) -> Column:
        """The addresses, each with the attributes of the stream tag right before it."""
        before = lambda i: F.get(x["places"], i - 1)
        each = F.transform(x["places"], lambda line, i: F.when(is_address(line), F.struct(line.alias("address"), F.when((i > 0) & is_tag(before(i), mark), attributes(rest(before(i)))).alias("a"), i.alias("pos"))))
        return let(F.struct(*(x[c].alias(c) for c in ("folder", "tracks", "maps", "keys", "duration", "ended", "timed")), F.array_compact(each).alias("addresses")), made)

    def made(x: Column) -> Column:
        streams = F.transform(F.filter(x["addresses"], lambda y: y["a"].isNotNull()), lambda y: F.struct(y["pos"].alias("pos"), variant(x["folder"], y).alias("x")))
        by_rate = F.array_sort(streams, lambda a, b: F.when(a["x"]["bandwidth"] > b["x"]["bandwidth"], -1).when(a["x"]["bandwidth"] < b["x"]["bandwidth"], 1).otherwise(a["pos"] - b["pos"]))
        segments = F.transform(F.filter(x["addresses"], lambda y: y["a"].isNull()), lambda y: resolved(x["folder"], y["address"]))
        master = F.exists(x["addresses"], lambda y: y["a"].isNotNull()) | (F.size(x["tracks"]) > 0)
        last = F.get(x["keys"], F.size(x["keys"]) - 1)["method"]
        return F.struct(
            F.lit("hls").alias("type"), master.alias("master"), F.transform(by_rate, lambda y: y["x"]).alias("variants"), F.filter(x["tracks"], lambda t: t["type"] == "audio").alias("audio_tracks"),
            F.filter(x["tracks"], lambda t: t["type"].isin("subtitles", "closed-captions")).alias("subtitle_tracks"), F.concat(F.reverse(x["maps"]), segments).alias("segments"), x["duration"].alias("duration"),
            (x["timed"] & ~x["ended"] & ~master).alias("live"), (F.size(x["keys"]) > 0).alias("encrypted"),
            F.when(F.size(x["keys"]) == 0, "").when(last.isin("", "NONE"), "UNDECLARED").otherwise(last).alias("encryption_method"),
            F.array_distinct(F.flatten(F.transform(x["keys"], lambda k: k["systems"]))).alias("key_systems"),
        )

    listed = F.when(F.btrim(body, F.lit(_SPACE)).startswith("#EXTM3U"), body)
    trimmed = F.transform(F.split(text(listed), r"\r?\n"), lambda line: F.btrim(line, F.lit(_SPACE)))
    return let(F.struct(trimmed.alias("lines"), U.folder_of(url).alias("folder")), lambda x: let(lines(x), paired)).cast(STREAM)


# ---------------------------------------------------------------- DASH


def _finite(value: str | None) -> float:
    try:
        n = float(value or 0)
    except ValueError:
        return 0.0
    return n if abs(n) < float("inf") else 0.0


#: Seconds of the units of a duration, before and after the T.
DATE_UNITS, TIME_UNITS = {"Y": 31_536_000, "M": 2_592_000, "D": 86_400}, {"H": 3600, "M": 60, "S": 1}


def iso_duration(value: str | None) -> float:
    """Seconds; a year has 365 days and a month 30; 0 if it cannot be read. Units come in falling order, each at most once."""
    if not (value or "").startswith("P"):
        return 0.0
    date, mark, time = value[1:].partition("T")
    total = 0.0
    for part, units in ((date, DATE_UNITS), (time, TIME_UNITS)):
        names = list(units)
        for amount, unit, stray in re.findall(r"([\d.]+)([A-Z])|(.)", part):
            if stray or unit not in names:
                return 0.0
            total += _finite(amount) * units[unit]
            names = names[names.index(unit) + 1 :]
    return total


def _events(body: str):
    """(local name, attributes, attributes of the enclosing element) of all elements; raises ValueError for what is not well formed."""
    out, around = [], [{}]

    def start(name, attrs):
        out.append((name.rpartition("\n")[2], attrs, around[-1]))
        around.append(attrs)

    def refuse(*_):
        raise ValueError("entities are not read")

    reader = expat.ParserCreate(namespace_separator="\n")
    reader.StartElementHandler, reader.EndElementHandler, reader.EntityDeclHandler = start, lambda name: around.pop(), refuse
    try:
        reader.Parse(body, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from None
    return out


def dash_description(body: str | None, base: str) -> dict:
    """A DASH description as STREAM. A Representation takes what it lacks from the element around it."""
    out = {"type": "dash", "master": True, "variants": [], "audio_tracks": [], "subtitle_tracks": [], "segments": [], "duration": 0.0, "live": False, "encrypted": False, "encryption_method": "", "key_systems": []}
    try:
        elements = _events((body or "").strip())
    except ValueError:
        return out
    root = elements[0][1]
    schemes = [((a.get("schemeIdUri") or "").lower(), a.get("value") or "cenc") for name, a, _ in elements if name == "ContentProtection"]
    common = [value.upper() for scheme, value in schemes if "mp4protection" in scheme]
    systems = [K.KEY_SYSTEMS.get(scheme.replace("urn:uuid:", "", 1)) for scheme, _ in schemes if "mp4protection" not in scheme]
    out |= {
        "live": root.get("type") == "dynamic", "duration": iso_duration(root.get("mediaPresentationDuration")), "encrypted": bool(schemes),
        "encryption_method": common[-1] if common else "CENC" if schemes else "", "key_systems": list(dict.fromkeys(filter(None, systems))),
    }
    for i, (own, up) in enumerate((a, up) for name, a, up in elements if name == "Representation"):
        mime = own.get("mimeType") or up.get("mimeType") or ""
        kind, name, lang = up.get("contentType") or mime.partition("/")[0], own.get("id") or str(i), up.get("lang") or ""
        if kind in ("audio", "text"):
            out["audio_tracks" if kind == "audio" else "subtitle_tracks"].append({"type": kind, "name": name, "language": lang, "group": "", "url": base, "is_default": False})
            continue
        sides = [_finite(own.get(x)) for x in ("width", "height")]
        out["variants"].append({
            "id": name, "bandwidth": _finite(own.get("bandwidth")), "resolution": "x".join(f"{x:g}" for x in sides) if all(sides) else "", "codecs": own.get("codecs") or up.get("codecs") or "",
            "frame_rate": 0.0, "group": "", "mime_type": mime, "lang": lang, "url": base,
        })
    out["variants"].sort(key=lambda v: -v["bandwidth"])
    return out


# ---------------------------------------------------------------- both


def manifest_type(url: Column, mime: Column, body: Column) -> Column:
    """dash or hls, by address, type or first character; hls if nothing is known."""
    dash = text(url).rlike(r"(?i)\.mpd(?:[?#]|\z)") | F.contains(F.lower(text(mime)), F.lit("dash+xml")) | F.ltrim(text(body)).startswith("<")
    return F.when(dash, "dash").otherwise("hls")


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Plain values as an Arrow array, a field at a time: pyarrow takes several times as long for nested dictionaries."""
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    if pa.types.is_list(kind):
        ends = pa.array(accumulate(map(len, values), initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, _column([x for v in values for x in v], kind.value_type), type=kind)
    return pa.array(values, kind)


def parsed(manifests: DataFrame) -> DataFrame:
    """url, mime_type and ``stream`` (STREAM) of manifests (url, mime_type, body)."""
    kinds = manifests.select("url", "mime_type", "body", manifest_type(F.col("url"), F.col("mime_type"), F.col("body")).alias("kind"))
    kept = f"url string, mime_type string, stream {STREAM}"

    def run(batches):
        for b in pieces(batches):
            rows = [dash_description(body, u or "") for u, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _column(rows, _PA_STREAM)], names=["url", "mime_type", "stream"])

    dash = kinds.where("kind = 'dash'").select("url", "mime_type", "body").mapInArrow(run, kept)
    return kinds.where("kind = 'hls'").select("url", "mime_type", hls_stream(F.col("url"), F.col("body")).alias("stream")).unionByName(dash)


def estimate_bytes(bandwidth: Column, seconds: Column) -> Column:
    return F.when((bandwidth > 0) & (seconds > 0), half_up(bandwidth / 8 * seconds)).otherwise(0).cast("long")


def variants(streams: DataFrame) -> DataFrame:
    """A display row per variant; a manifest without any stands for one itself."""
    alone = F.array(F.struct(F.lit("").alias("id"), F.lit(0.0).alias("bandwidth"), F.lit("").alias("resolution"), F.lit("").alias("codecs"), F.lit(0.0).alias("frame_rate"), F.lit("").alias("group"), F.lit("").alias("mime_type"), F.lit("").alias("lang"), F.col("url").alias("url")))
    rows = streams.select("url", "stream", F.posexplode(F.when(F.size("stream.variants") > 0, F.col("stream.variants")).otherwise(alone)).alias("pos", "v"))
    size = estimate_bytes(F.col("v.bandwidth"), F.col("stream.duration"))
    return rows.select(F.col("url").alias("manifest"), "pos", F.col("v.url").alias("url"), "v.id", "v.resolution", "v.codecs", half_up(F.col("v.bandwidth") / 1000).cast("long").alias("kbps"), size.alias("bytes"), format_bytes(size).alias("size"), "stream.encrypted")


def tracks(streams: DataFrame) -> DataFrame:
    return streams.select(F.col("url").alias("manifest"), F.posexplode(F.concat("stream.audio_tracks", "stream.subtitle_tracks")).alias("pos", "t")).select("manifest", "pos", "t.*")


def segments(streams: DataFrame) -> DataFrame:
    return streams.select(F.col("url").alias("manifest"), F.posexplode("stream.segments").alias("pos", "segment"))


def segment_list(streams: DataFrame, chosen: DataFrame) -> DataFrame:
    """The export of chosen variants (manifest, variant): a master without segments shows those of the variant's playlist."""
    own = streams.select(F.col("url").alias("manifest"), "stream.type", "stream.duration", F.col("stream.segments").alias("own"))
    media = streams.select(F.col("url").alias("variant"), F.col("stream.segments").alias("media"), F.col("stream.duration").alias("media_duration"))
    rows = chosen.join(own, "manifest").join(media, "variant", "left")
    none = F.size("own") == 0
    return rows.select("manifest", "type", F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.coalesce("media_duration", F.lit(0.0))).alias("duration"), "variant", F.when(none, F.coalesce("media", F.col("own"))).otherwise(F.col("own")).alias("segments"))


def mark_protected(items: DataFrame, streams: DataFrame) -> DataFrame:
    """Items whose manifest is encrypted get the status protected and a reason."""
    locked = streams.where("stream.encrypted").select("url", F.concat_ws(", ", "stream.encryption_method", F.array_join("stream.key_systems", ", ")).alias("why"))
    rows = items.join(locked.dropDuplicates(["url"]), "url", "left")
    reason = F.when(F.col("why").isNotNull(), F.concat(F.lit("encrypted stream: "), F.col("why")))
    own = F.col("protected_reason") if "protected_reason" in items.columns else F.lit(None).cast("string")
    return rows.withColumns({"status": F.when(F.col("why").isNotNull(), "protected").otherwise(F.col("status")), "protected_reason": F.coalesce(reason, own)}).drop("why")
