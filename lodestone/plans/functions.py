"""Table functions for SQL: media_urls(json, base), dom_candidates(html), parse_manifest(body, url, mime_type)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class MediaUrls:
    """The strings of a JSON document that the walk reaches, with their order; test and resolve them with functions.media and url."""

    def eval(self, document: str, base: str):
        from lodestone.sources.payloads import strings

        for pos, value in enumerate(strings(document)):
            yield pos, value, base


class DomCandidates:
    """The media references of an HTML document in the order of collection, as written."""

    def eval(self, html: str):
        from lodestone.sources.dom import scan

        for pos, row in enumerate(scan(html)):
            yield pos, row["url"], row["kind"], row["mime_type"], row["repeat_depth"], row["checked"]


class ParseManifest:
    """A row per variant of a manifest, in its order of rate. DataFrames go through sources.manifests.parsed, which tells more."""

    def eval(self, body: str, url: str, mime_type: str):
        import re
        from urllib.parse import urljoin

        from lodestone.sources.manifests import dash_description

        body, url = body or "", url or ""
        if "dash+xml" in (mime_type or "").lower() or url.partition("?")[0].lower().endswith(".mpd") or body.lstrip().startswith("<"):
            stream = dash_description(body, url)
            for pos, v in enumerate(stream["variants"]):
                yield "dash", pos, v["url"], v["bandwidth"], v["resolution"], stream["encrypted"]
            return
        value = lambda tag, name: next((m[1] or m[2] for m in re.finditer(rf'(?:^|,)\s*{name}=(?:"([^"]*)"|([^,]*))', tag)), "")
        # a stream tag and the address that follows it, other tags between them
        found = re.findall(r"(?m)^#EXT-X-STREAM-INF:(.*)\n(?:[ \t]*(?:#(?!EXT-X-STREAM-INF:).*)?\n)*[ \t]*([^#\s].*)", body.replace("\r\n", "\n")) if body.lstrip().startswith("#EXTM3U") else []
        locked = any(value(k, "METHOD") != "NONE" or value(k, "URI") or value(k, "KEYFORMAT") for k in re.findall(r"(?m)^#EXT-X-(?:SESSION-)?KEY:(.*)", body))
        rated = []
        for tag, address in found:
            rate = value(tag, "BANDWIDTH") or value(tag, "AVERAGE-BANDWIDTH")
            try:
                address = urljoin(url, address.strip())
            except ValueError:  # stays as it is written
                address = address.strip()
            rated.append((float(rate) if re.fullmatch(r"[0-9]+(?:\.[0-9]*)?", rate) else 0.0, address, value(tag, "RESOLUTION")))
        for pos, (rate, address, resolution) in enumerate(sorted(rated, key=lambda x: -x[0])):
            yield "hls", pos, address, rate, resolution, locked


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("media_urls", udtf(MediaUrls, returnType="pos int, value string, base string"))
    spark.udtf.register("dom_candidates", udtf(DomCandidates, returnType="pos int, url string, kind string, mime_type string, repeat_depth int, checked boolean"))
    spark.udtf.register("parse_manifest", udtf(ParseManifest, returnType="type string, pos int, url string, bandwidth double, resolution string, encrypted boolean"))
