"""Media type functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.core import let, lookup, slug_tail, text

_KNOWN = r"(?i)\.(" + "|".join([*K.IMAGE_EXT, *K.VIDEO_EXT, *K.AUDIO_EXT, *K.STREAM_EXT]) + r")(?:[?#]|\z)"


def ext_of(url: Column) -> Column:
    """A known extension anywhere before ``?``, ``#`` or the end; else the tail of the path."""
    url = text(url)
    known = F.lower(F.regexp_extract(F.substring_index(url, "#", 1), _KNOWN, 1))
    tail = slug_tail(F.regexp_extract(url, r"(?s)\A([^?#]*)", 1))
    ext = F.lower(F.regexp_extract(tail, r"(?s)\A.+\.([A-Za-z0-9]{1,5})\z", 1))
    return let(known, lambda k: F.when(k != "", k).otherwise(ext))


def kind_from_ext(ext: Column) -> Column:
    return F.when(ext.isin(K.STREAM_EXT), "stream").when(ext.isin(K.IMAGE_EXT), "image").when(ext.isin(K.VIDEO_EXT), "video").when(ext.isin(K.AUDIO_EXT), "audio").otherwise("")


def _type(mime: Column) -> Column:
    return F.lower(F.trim(F.substring_index(text(mime), ";", 1)))


def kind_from_mime(mime: Column) -> Column:
    return let(
        _type(mime),
        lambda t: F.when(t.isin(K.STREAM_MIME), "stream").when(t.startswith("image/"), "image").when(t.startswith("video/"), "video").when(t.startswith("audio/"), "audio").otherwise(""),
    )


def mime_subtype(mime: Column) -> Column:
    return F.regexp_extract(_type(mime), r"(?s)\A[^/]*/(.*)\z", 1)


def mime_top_level(mime: Column) -> Column:
    return F.regexp_extract(_type(mime), r"(?s)\A([^/]*)/", 1)


def classify(url: Column, mime: Column) -> Column:
    """The MIME type decides, then the extension."""
    return let(kind_from_mime(mime), lambda k: F.when(k != "", k).otherwise(kind_from_ext(ext_of(url))))


def ext_from_mime(mime: Column) -> Column:
    sub = mime_subtype(mime)
    return text(F.coalesce(lookup(sub, K.MIME_EXT), lookup(F.regexp_replace(sub, r"\Ax-", ""), K.MIME_EXT)))


def looks_like_media(s: Column) -> Column:
    s = text(s)
    tail = slug_tail(F.regexp_extract(s, r"(?s)\A([^?#]*)", 1))
    shaped = (s.rlike("(?i)" + K.CDN_PATH) | s.rlike("(?i)" + K.CDN_HOST)) & (F.length(tail) >= 8) & ~tail.contains(".")
    return F.length(s).between(8, K.MAX_URL) & s.rlike(r"\A(?:https?://|//|/[^/])") & ~s.rlike("(?i)" + K.NON_MEDIA_EXT) & (s.rlike(_KNOWN) | shaped)


def scan_prefilter(s: Column, inline: bool = True) -> Column:
    """The narrower test of the scanner (``inline``: it also takes data: and blob: URLs) and of the JSON miner: no host shape."""
    s = text(s)
    tail = slug_tail(F.regexp_extract(s, r"(?s)\A([^?#]*)", 1))
    shaped = s.rlike("(?i)" + K.CDN_PATH) & (F.length(tail) >= 8) & ~tail.contains(".")
    plain = s.rlike(r"\A(?:https?://|//|/[^/])") & ~s.rlike("(?i)" + K.NON_MEDIA_EXT) & (s.rlike(_KNOWN) | shaped)
    if not inline:
        return F.length(s).between(8, K.MAX_URL) & plain
    return (F.length(s) >= 5) & (s.rlike(r"\A(?:data:(?:image|video|audio)/|blob:)") | ((F.length(s) <= K.MAX_URL) & plain))


def is_data(url: Column) -> Column:
    return text(url).startswith("data:")


def is_blob(url: Column) -> Column:
    return text(url).startswith("blob:")


def data_uri_bytes(url: Column) -> Column:
    head = F.substring_index(url, ",", 1)
    payload = F.length(url) - F.length(head) - 1
    size = F.when(head.contains(";base64"), F.floor(payload * 0.75)).otherwise(payload)
    return F.when(is_data(url) & url.contains(","), size).otherwise(0).cast("long")


def data_uri_mime(url: Column) -> Column:
    return F.when(is_data(url), F.substring_index(F.substring(F.substring_index(url, ",", 1), 6, 1_000_000), ";", 1)).otherwise("")


def rejection_reason(url: Column, width: Column, height: Column, size: Column) -> Column:
    """Why a sighting is not worth keeping, empty if it is. A null size is never a pixel's."""
    side = F.greatest(F.coalesce(width.cast("double"), F.lit(0.0)), F.coalesce(height.cast("double"), F.lit(0.0)))
    pixel = size.isNotNull() & (size < K.PIXEL_MAX_BYTES) & (side > 0) & (side <= K.PIXEL_MAX_SIDE)
    return (
        F.when(pixel, "tracking-pixel")
        .when(is_data(url) & url.rlike(r"(?i)\Adata:image/(?:x-icon|vnd\.microsoft\.icon)"), "favicon")
        .when(is_data(url) & (data_uri_bytes(url) < K.DATA_URI_MIN_BYTES), "tiny-data-uri")
        .when(text(url).rlike(r"(?i)/favicon\.(?:ico|png)(?:[?#]|\z)"), "favicon")
        .otherwise("")
    )


def resolve_threshold(value) -> float:
    """A number clamped to the slider's range, a preset's name, or the default."""
    try:
        n = float(value) if value not in ("", None) else math.nan
    except (TypeError, ValueError):
        n = math.nan
    if math.isfinite(n):
        return min(K.THRESHOLD_MAX, max(K.THRESHOLD_MIN, n))
    return K.PRESETS.get(value, K.THRESHOLD) if isinstance(value, str) else K.THRESHOLD


def threshold_name(value: float) -> str:
    """The nearest preset, the first of equals."""
    return min(K.PRESETS, key=lambda name: abs(K.PRESETS[name] - value))
