"""Controls of HTML documents: what a person could click, described as the crawl policy judges it.

A document is read once, element by element in document order. An open element carries what its content inherits (whether it
is rendered and visible, the pointer, the form and the link around it), so no ancestors are searched. Its number and the
count of elements when it closes bound its content: pre-order number ``pos`` and ``last``, the greatest number within it.
Text and media within are known when it closes, from how far the text and the count of media had come when it opened.

Styles are those of style attributes and of browsers by default (links point, a closed ``details`` shows its summary only);
style sheets and layout are not computed. An area is that of declared pixels, else ``assumed_area``. Elements that a document
leaves out (html, head, body) count as scanned. A null or empty document has no controls, an unclosed element ends where its
document does, and repeated documents are read each on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import url as U
from lodestone.functions.core import text
from lodestone.sources.pieces import pieces

MAX_SCANNED, MAX_CONTROLS = 3001, 120
TEXT_MAX, CLASS_MAX, ID_MAX = 120, 200, 80
#: The least area that the policy accepts.
ASSUMED_AREA = 64.0
MIN_OPACITY = 0.05
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNRENDERED = frozenset("head script style template title noscript".split())
OWN_POINTER = frozenset("button input select textarea".split())
FORM_MEMBERS = frozenset("button fieldset input object output select textarea".split())
MEDIA = frozenset(("img", "video", "picture", "canvas"))
CONTROL = (
    "pos int, last int, tag string, role string, type string, text string, ariaLabel string, title string, alt string, className string, id string, testId string, href string, target string, "
    "hasDownloadAttr boolean, insideForm boolean, insideLink boolean, ariaExpanded string, ariaSelected string, ariaHasPopup string, ariaControls boolean, disabled boolean, visible boolean, containsMedia boolean, area double"
)
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
_STRUCT = pa.struct([(n, _KINDS[k]) for n, k in (x.split(" ") for x in CONTROL.split(", "))])


@dataclass
class Open:
    """An element whose end has not come, and what its content inherits from it."""

    tag: str
    rendered: bool
    visible: bool
    pointer: bool
    in_form: bool
    in_link: bool
    is_open: bool = False  # of details
    closed_details: bool = False
    summaries: int = 0
    control: dict | None = None
    text_from: int = 0
    media_from: int = 0


@dataclass
class Style:
    """The declarations of a style attribute that matter here."""

    rules: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, attribute: str) -> Style:
        pairs = (x.partition(":") for x in attribute.split(";"))
        return cls({name.strip().lower(): value.replace("!important", "").strip().lower() for name, _, value in pairs})

    def pixels(self, name: str) -> float | None:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)(?:px)?", self.rules.get(name, ""))
        return float(m[1]) if m else None

    def opacity(self) -> float:
        m = re.fullmatch(r"(\d*\.?\d+)(%?)", self.rules.get("opacity", ""))
        return float(m[1]) / (100 if m[2] else 1) if m else 1.0


def cut(value: str, units: int) -> str:
    """The first ``units`` UTF-16 units; half a pair is left out."""
    return value if len(value) * 2 <= units else value.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "ignore")


class Reader(HTMLParser):
    def __init__(self, clicked: str, assumed_area: float):
        super().__init__(convert_charrefs=True)
        self.clicked, self.assumed_area = clicked, assumed_area
        self.around = [Open("", True, True, False, False, False)]
        self.n, self.media, self.controls = 0, 0, []
        self.said: list[str] = []
        self.length = 0
        self.forms: set[str] = set()

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in reversed(attrs)}
        if self.n == 0 and tag != "html":
            self.n = 1
        if self.n == 1 and tag not in ("html", "head"):
            self.n = 2
        if self.n and tag not in ("html", "head", "body", "base", "link", "meta", "script", "style", "title", "template", "noscript") and not any(x.tag == "body" for x in self.around):
            self.around.append(Open("body", True, True, False, False, False))
            self.n += 1
        number, up, style = self.n, self.around[-1], Style.of(at.get("style", ""))
        self.n += 1
        up.summaries += tag == "summary"
        hidden = "hidden" in at or style.rules.get("display") == "none" or tag in UNRENDERED or (tag == "dialog" and "open" not in at) or (tag == "input" and at.get("type", "").lower() == "hidden")
        behind = up.closed_details and not (tag == "summary" and up.summaries == 1)
        shown = style.rules.get("visibility")
        cursor = style.rules.get("cursor", "").split(",")[-1].strip()
        now = Open(
            tag, rendered=up.rendered and not hidden and not behind, visible=up.visible if shown in (None, "inherit") else shown == "visible",
            pointer=cursor == "pointer" if cursor not in ("", "inherit") else "href" in at if tag == "a" and "href" in at else False if tag in OWN_POINTER else up.pointer,
            in_form=up.in_form or tag == "form", in_link=up.in_link or (tag == "a" and "href" in at), is_open="open" in at, closed_details=tag == "details" and "open" not in at,
            text_from=self.length, media_from=self.media + (tag in MEDIA),
        )
        self.media += tag in MEDIA
        if tag == "form" and at.get("id"):
            self.forms.add(at["id"])
        if number < MAX_SCANNED and len(self.controls) < MAX_CONTROLS and self.clicked not in at:
            now.control = self._control(number, tag, at, now, up, style)
            if now.control:
                self.controls.append(now.control)
        if tag in VOID:
            self._end(now)
        else:
            self.around.append(now)

    def _control(self, number: int, tag: str, at: dict[str, str], now: Open, up: Open, style: Style) -> dict | None:
        role = at.get("role", "").lower()
        affords = tag in ("button", "summary") or role in ("button", "tab") or at.get("tabindex", "-1") != "-1" or not at.keys().isdisjoint(("aria-expanded", "aria-haspopup", "aria-controls")) or now.pointer
        sides = [style.pixels(x) if style.pixels(x) is not None else Style({x: at.get(x, "")}).pixels(x) for x in ("width", "height")]
        if not affords or not now.rendered or not now.visible or style.opacity() <= MIN_OPACITY or 0.0 in sides:
            return None
        return {
            "pos": number, "last": number, "tag": tag, "role": role, "type": at.get("type", "").lower(), "text": "", "ariaLabel": at.get("aria-label", ""), "title": at.get("title", ""), "alt": at.get("alt", ""),
            "className": cut(at.get("class", ""), CLASS_MAX), "id": cut(at.get("id", ""), ID_MAX), "testId": at.get("data-testid", ""), "href": at.get("href", "") if tag == "a" else "", "target": at.get("target", ""),
            "hasDownloadAttr": "download" in at, "insideForm": now.in_form, "insideLink": now.in_link,
            "ariaExpanded": str(up.tag == "details" and up.is_open).lower() if tag == "summary" else at.get("aria-expanded", ""), "ariaSelected": at.get("aria-selected", ""), "ariaHasPopup": at.get("aria-haspopup", ""),
            "ariaControls": bool(at.get("aria-controls")), "disabled": (tag in FORM_MEMBERS and "disabled" in at) or at.get("aria-disabled") == "true", "visible": True, "containsMedia": False,
            "area": float(round(sides[0] * sides[1])) if None not in sides else self.assumed_area, "form": at.get("form", "") if tag in FORM_MEMBERS else "",
        }

    def _end(self, closed: Open) -> None:
        if closed.control:
            closed.control |= {"last": self.n - 1, "text": self._text(closed.text_from), "containsMedia": self.media > closed.media_from}

    def _text(self, start: int) -> str:
        """The first characters of what was said since ``start``."""
        out, at = [], self.length
        for part in reversed(self.said):
            at -= len(part)
            if at + len(part) <= start:
                break
            out.append(part[max(0, start - at) :])
        return cut("".join(reversed(out)), TEXT_MAX)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(x.tag == tag for x in self.around[1:]):
            while True:
                closed = self.around.pop()
                self._end(closed)
                if closed.tag == tag:
                    return

    def handle_data(self, data):
        self.said.append(data)
        self.length += len(data)

    def finish(self) -> list[dict]:
        self.close()
        while len(self.around) > 1:
            self._end(self.around.pop())
        for c in self.controls:
            c["insideForm"] = c["insideForm"] or c.pop("form") in self.forms
            c.pop("form", None)
        return self.controls


def read(html: str | None, clicked: str = "data-clicked", assumed_area: float = ASSUMED_AREA) -> list[dict]:
    reader = Reader(clicked, assumed_area)
    reader.feed(html or "")
    return reader.finish()


def controls(pages: DataFrame, clicked: str = "data-clicked", assumed_area: float = ASSUMED_AREA) -> DataFrame:
    """page_id, url and CONTROL of the controls of pages (page_id, url, html), at most MAX_CONTROLS a page among its first
    MAX_SCANNED elements; elements with the attribute ``clicked`` are left out. Addresses of links are resolved."""

    def run(batches):
        for b in pieces(batches):
            rows = [read(html, clicked, assumed_area) for html in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(_STRUCT))], names=["page_id", "url", "found"])

    kept = pages.select("page_id", "url", "html")
    types = dict(kept.dtypes)
    found = kept.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, found array<struct<{CONTROL.replace(' ', ':').replace(',:', ',')}>>")
    rows = found.select("page_id", F.col("url"), F.inline("found"))
    return rows.withColumn("href", F.when(F.col("href") != "", F.coalesce(U.href(U.parse(F.col("href"), F.col("url"))), F.col("href"))).otherwise(text(F.col("href"))))
