"""Media candidates of HTML documents, with their place in the document's structure.

The document is walked in Python (html.parser); tests, resolution and first-wins are Column expressions after it. Facts that
only a browser knows (decoded size, computed style, canvas pixels) are not in the text and stay unknown.
"""

from __future__ import annotations

import itertools
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import media as M
from lodestone.functions.paths import best_of_srcset
from lodestone.operators.index import absolute
from lodestone.sources.pieces import pieces

PATH_DEPTH, REPEAT_LEVELS, REPEAT_SIBLINGS, MAX_COUNTS, MAX_CLASSES = 16, 6, 3, 64, 12
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CANDIDATE = (
    "struct<url:string,checked:boolean,kind:string,mime_type:string,width:double,height:double,alt:string,poster:boolean,preview:string,"
    "structural_path:array<struct<tag:string,classes:array<string>>>,repeat_depth:int,class_counts:map<string,int>>"
)


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = attrs.get("class", "").split()
        self.signature = (tag, tuple(sorted(self.classes[:MAX_CLASSES])))
        self.alike: Counter | None = None

    def siblings_alike(self) -> int:
        """How many of the parent's children look like this one, itself included; they are counted once per parent."""
        if self.parent.alike is None:
            self.parent.alike = Counter(n.signature for n in self.parent.children)
        return self.parent.alike[self.signature]

    def up(self):
        node = self
        while node is not None and node.tag:
            yield node
            node = node.parent

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent


def class_frequency(nodes: list[Node]) -> dict[str, int]:
    out: dict[str, int] = {}
    for node in nodes:
        for name in node.classes:
            out[name] = out.get(name, 0) + 1
    return out


def structure(node: Node, frequency: dict[str, int]) -> dict:
    path, counts = [], {}
    for n in node.up():
        path.append({"tag": n.tag, "classes": n.classes[:MAX_CLASSES]})
        if n.tag == "body" or len(path) == PATH_DEPTH:
            break
    for n in path:
        for c in n["classes"]:
            if c not in counts and len(counts) < MAX_COUNTS:
                counts[c] = frequency.get(c, 0)
    depth = -1
    for i, n in enumerate(node.up()):
        if i == REPEAT_LEVELS or n.parent is None or not n.parent.tag:
            break
        if n.siblings_alike() >= REPEAT_SIBLINGS:
            depth = i
            break
    return {"structural_path": path, "repeat_depth": depth, "class_counts": counts}


def scan(html: str | None) -> list[dict]:
    """Candidates in the order of collection: images, players, pictures, embeds, anchors, posters, then lazy attributes and
    styles of all elements. ``checked``: only taken if its address looks like media."""
    nodes = list(Tree(html or "").root.walk())
    frequency = class_frequency(nodes)
    out: list[dict] = []

    def push(node: Node, url: str, checked: bool = False, **extra) -> None:
        if url.strip():
            row = {"url": url, "checked": checked, "kind": "", "mime_type": "", "width": 0.0, "height": 0.0, "alt": "", "poster": False, "preview": ""}
            out.append(row | structure(node, frequency) | extra)

    def below(node: Node, tag: str):
        return (n for n in node.walk() if n.tag == tag)

    by_tag: dict[str, list[Node]] = {}
    for n in nodes:
        by_tag.setdefault(n.tag, []).append(n)
    for n in by_tag.get("img", ()):
        a = n.attrs
        src = best_of_srcset(a.get("srcset")) or a.get("src", "")
        push(n, src, kind="image", alt=a.get("alt", ""))
        link = next((p for p in n.up() if p.tag == "a" and "href" in p.attrs), None)
        if link is not None:
            push(n, link.attrs["href"], True, kind="image", alt=a.get("alt", ""), preview=src)
    for tag in ("video", "audio"):
        for n in by_tag.get(tag, ()):
            push(n, n.attrs.get("src", ""), kind=tag)
            push(n, n.attrs.get("poster", ""), kind="image", poster=True)
            for s in below(n, "source"):
                push(n, s.attrs.get("src") or best_of_srcset(s.attrs.get("srcset")), kind=tag, mime_type=s.attrs.get("type", ""))
            for t in below(n, "track"):
                push(n, t.attrs.get("src", ""), kind="text", mime_type="text/vtt")
    for n in by_tag.get("picture", ()):
        for s in below(n, "source"):
            push(n, best_of_srcset(s.attrs.get("srcset")), kind="image", mime_type=s.attrs.get("type", ""))
    for tag in ("object", "embed", "iframe"):
        for n in by_tag.get(tag, ()):
            push(n, n.attrs.get("data") or n.attrs.get("src", ""), True)
    for n in by_tag.get("a", ()):
        if "href" in n.attrs and not any(True for _ in below(n, "img")):
            push(n, n.attrs["href"], True)
    for n in nodes:
        if "poster" in n.attrs and n.tag not in ("video", "audio"):
            push(n, n.attrs["poster"], kind="image", poster=True)
    for n in nodes:
        for name, value in n.attrs.items():
            if name.startswith("data-") and 0 < len(value) <= 4096:
                push(n, best_of_srcset(value) if name.endswith("srcset") else value, True)
        for url in css_urls(n.attrs.get("style", "")):
            push(n, url, True, kind="image")
    return out


def css_urls(style: str) -> list[str]:
    """URLs of the style's background, border and mask images, in plain Python."""
    import re

    out = []
    for name, value in (d.split(":", 1) for d in re.findall(r"(?:[^;(]|\([^)]*\))+", style) if ":" in d):
        if re.fullmatch(r"(?i)\s*(?:background|background-image|border-image|border-image-source|mask|mask-image|-webkit-mask-image)\s*", name):
            out += [m[1] for m in re.findall(r"""url\((['"]?)(.*?)\1\)""", value) if m[1]]
    return out


def candidates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The page's columns but its html, seq, and a candidate's columns: absolute, the first of each address in its page."""
    others = [c for c in pages.columns if c != html]
    own = [c for c in others if c != url]
    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField("found", T._parse_datatype_string(f"array<{CANDIDATE}>"))])
    kind = pa.list_(
        pa.struct([
            ("url", pa.string()), ("checked", pa.bool_()), ("kind", pa.string()), ("mime_type", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("alt", pa.string()),
            ("poster", pa.bool_()), ("preview", pa.string()), ("structural_path", pa.list_(pa.struct([("tag", pa.string()), ("classes", pa.list_(pa.string()))]))),
            ("repeat_depth", pa.int32()), ("class_counts", pa.map_(pa.string(), pa.int32())),
        ])
    )

    def run(batches):
        for b in pieces(batches):
            found = [[r | {"class_counts": list(r["class_counts"].items())} for r in scan(x)] for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=schema.names)

    rows = pages.select(*others, html).mapInArrow(run, schema).select(*own, F.col(url).alias("page_url"), F.posexplode("found").alias("seq", "c")).select(*own, "page_url", "seq", "c.*")
    target = absolute(F.col("url"), F.col("page_url"))
    preview = absolute(F.col("preview"), F.col("page_url"))
    rows = rows.withColumns({"address": target, "shown": preview})
    rows = rows.where((F.col("address") != "") & (~F.col("checked") | (M.scan_prefilter(F.col("address")) & (F.col("address") != F.col("shown")))))
    first = Window.partitionBy(*own, "page_url", "address").orderBy("seq")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    shown = F.when(F.col("shown").rlike("(?i)^https?:"), F.col("shown")).otherwise("")
    return rows.withColumns({"url": F.col("address"), "preview_url": shown, "source": F.lit("dom"), "status": F.lit("referenced"), "in_repeated_group": F.col("repeat_depth") >= 0, "bytes": F.lit(None).cast("double")}).drop("address", "shown", "preview", "checked", "n")


MIN_SVG = 8
#: What a canvas measures where it does not say.
CANVAS = (300, 150)
DRAWING = "struct<tag:string,element:int,width:double,height:double>"


def drawings_of(html: str | None) -> list[tuple[str, int, float, float]]:
    """(tag, number of the element, width, height) of outermost svgs of MIN_SVG pixels or more and of canvases that are not empty."""

    def pixels(value: str | None, none: float) -> float:
        head = "".join(itertools.takewhile(lambda c: c in "0123456789.", (value or "").strip()))
        rest = (value or "").strip()[len(head) :]
        return float(head) if head.replace(".", "", 1).isdigit() and rest in ("", "px") else none

    out = []
    for number, n in enumerate(Tree(html or "").root.walk()):
        if n.tag == "canvas":
            size = [float(int(pixels(n.attrs.get(k), d))) for k, d in zip(("width", "height"), CANVAS, strict=True)]
        elif n.tag == "svg" and not any(p.tag == "svg" for p in n.parent.up()):
            size = [pixels(n.attrs.get(k), 0.0) for k in ("width", "height")]
        else:
            continue
        if min(size) >= (MIN_SVG if n.tag == "svg" else 1):
            out.append((n.tag, number, *size))
    return out


def drawings(pages: DataFrame, scheme: str, tainted: DataFrame | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """page_id, page_url, seq, url, kind, mime_type, width, height, status, protected_reason, synthetic, source of the drawings
    of pages (page_id, url, html): addresses are ``scheme``-svg and ``scheme``-canvas with the element's number. Sizes are the
    declared ones. tainted (page_id, element): canvases that a browser could not read. No markup gives no rows."""
    kind = pa.list_(pa.struct([("tag", pa.string()), ("element", pa.int32()), ("width", pa.float64()), ("height", pa.float64())]))
    key = dict(pages.dtypes)["page_id"]

    def run(batches):
        for b in pieces(batches):
            found = [[dict(zip(("tag", "element", "width", "height"), x, strict=True)) for x in drawings_of(text)] for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], names=["page_id", "page_url", "found"])

    rows = pages.select("page_id", url, html).mapInArrow(run, f"page_id {key}, page_url string, found array<{DRAWING}>")
    rows = rows.select("page_id", "page_url", F.posexplode("found").alias("seq", "d")).select("page_id", "page_url", "seq", "d.*")
    if tainted is None:
        rows = rows.withColumn("locked", F.lit(False))
    else:
        marked = tainted.select("page_id", "element").distinct().withColumn("mark", F.lit(True))
        rows = rows.join(marked, ["page_id", "element"], "left").withColumn("locked", F.coalesce("mark", F.lit(False)) & (F.col("tag") == "canvas"))
    return rows.select(
        "page_id", "page_url", "seq", F.concat(F.lit(f"{scheme}-"), "tag", F.lit(":"), F.col("element").cast("string")).alias("url"), F.lit("image").alias("kind"),
        F.when(F.col("tag") == "svg", "image/svg+xml").otherwise("image/png").alias("mime_type"), "width", "height", F.when(F.col("locked"), "unavailable").otherwise("confirmed").alias("status"),
        F.when(F.col("locked"), "Canvas is cross-origin tainted").otherwise("").alias("protected_reason"), F.col("tag").alias("synthetic"), F.lit("dom").alias("source"),
    )
