"""Crawl policy as Column expressions: what may be clicked, which links may be followed, and which come first.

Risk and opportunity words match as substrings, and an unknown control is never clicked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import url as U
from lodestone.functions.core import contains_any, let, text


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[\s\x{A0}\x{FEFF}]+", " "))


def _field(el: dict[str, Column], name: str) -> Column:
    return text(el[name]) if name in el else F.lit("")


def accessible_text(el: dict[str, Column]) -> Column:
    fields = [F.when(_field(el, n) != "", _field(el, n)) for n in ("text", "ariaLabel", "title", "alt", "name", "value") if n in el]
    return normalise(F.concat_ws(" ", *fields)) if fields else F.lit("")


def token_text(el: dict[str, Column]) -> Column:
    return F.regexp_replace(normalise(F.concat_ws(" ", _field(el, "className"), _field(el, "id"), _field(el, "testId"))), "[-_/]+", " ")


def risky(c: Column) -> Column:
    return contains_any(c, K.RISK_WORDS)


def promising(c: Column) -> Column:
    return contains_any(c, K.OPPORTUNITY_WORDS)


def is_disclosure(el: dict[str, Column]) -> Column:
    expanded, popup = _field(el, "ariaExpanded"), _field(el, "ariaHasPopup")
    controls = text(el["ariaControls"].cast("string")).isin("", "false") if "ariaControls" in el else F.lit(True)
    return (
        F.when((expanded == "true") | (_field(el, "ariaSelected") == "true"), False)
        .when(expanded == "false", True)
        .when((popup != "") & (popup != "false"), True)
        .when(~controls, True)
        .when(_field(el, "role") == "tab", True)
        .otherwise(F.lower(_field(el, "tag")) == "summary")
    )


def should_click(el: dict[str, Column]) -> Column:
    """(click, reason) of an element; el maps the names of its properties to columns, missing ones are empty."""
    flag = lambda n, default=False: F.coalesce(el[n], F.lit(default)) if n in el else F.lit(default)
    tag = F.lower(_field(el, "tag"))
    area = F.coalesce(el["area"], F.lit(0.0)) if "area" in el else F.lit(0.0)
    no, yes = (lambda r: F.struct(F.lit(False).alias("click"), F.lit(r).alias("reason"))), (lambda r: F.struct(F.lit(True).alias("click"), F.lit(r).alias("reason")))

    def judge(x: Column) -> Column:
        words, tokens = x["words"], x["tokens"]
        return (
            F.when(flag("disabled"), no("disabled"))
            .when(~flag("visible", True), no("not visible"))
            .when(area < 64, no("too small to be a control"))
            .when(tag.isin("input", "textarea", "select", "option", "label", "form"), no("form control"))
            .when(flag("insideForm"), no("inside a form"))
            .when((tag == "button") & (F.lower(_field(el, "type")) == "submit"), no("submit button"))
            .when(flag("hasDownloadAttr"), no("starts its own download"))
            .when(_field(el, "target") == "_blank", no("opens a new tab"))
            .when(risky(words) | risky(tokens), no("reads as transactional or destructive"))
            .when((tag == "a") & (_field(el, "href") != "") & ~_field(el, "href").rlike("(?i)^javascript:"), no("link — queued for navigation instead"))
            .when(flag("insideLink"), no("inside a link — navigation, not a control"))
            .when(flag("containsMedia"), yes("wraps media — likely opens it larger"))
            .when(promising(words) | promising(tokens), yes("reads as a media control"))
            .when(is_disclosure(el), yes("opens or expands something not open yet"))
            .otherwise(no("no positive reason to believe it reveals media"))
        )

    return let(F.struct(accessible_text(el).alias("words"), token_text(el).alias("tokens")), judge)


def decode_or_same(c: Column) -> Column:
    """Percent-decoded; plus stays, and what cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def should_follow(href: Column, page: Column, el: dict[str, Column] | None = None) -> Column:
    """(follow, reason) of a link on a page."""
    el = el or {}
    no = lambda r: F.struct(F.lit(False).alias("follow"), F.lit(r).alias("reason"))
    download = F.coalesce(el["hasDownloadAttr"], F.lit(False)) if "hasDownloadAttr" in el else F.lit(False)
    label = risky(accessible_text(el)) | risky(token_text(el)) if el else F.lit(False)

    def judge(x: Column) -> Column:
        t, o = x["t"], x["o"]
        search = F.when(text(t["query"]) == "", "").otherwise(F.concat(F.lit("?"), t["query"]))
        raw = F.concat(t["path"], F.lit(" "), search)
        address = lambda c: risky(F.regexp_replace(normalise(c), "[-_/?&=:+%]+", " "))
        return (
            F.when(text(href) == "", no("no href"))
            .when(t.isNull() | o.isNull(), no("unparseable"))
            .when(~U.is_http(t), no("not http"))
            .when(U.origin(t) != U.origin(o), no("different origin"))
            .when(download, no("starts its own download"))
            .when(label, no("reads as transactional or destructive"))
            .when(address(raw) | address(decode_or_same(raw)), no("address reads as transactional or destructive"))
            .otherwise(F.struct(F.lit(True).alias("follow"), F.lit("same origin").alias("reason")))
        )

    return let(F.struct(U.parse(href, page).alias("t"), U.parse(page).alias("o")), judge)


def link_priority(href: Column, start: Column, el: dict[str, Column] | None = None) -> Column:
    """How promising a link is against the address that the crawl began at; 0 if either cannot be parsed."""
    el = el or {}
    label = F.concat_ws(" ", accessible_text(el), token_text(el)) if el else F.lit("")

    def address(p: Column) -> Column:
        search = F.when(text(p["query"]) == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
        return U.path_tokens(F.regexp_replace(F.concat(p["path"], F.lit("/"), search), "[?&=:]+", "/"))

    def value(x: Column) -> Column:
        t, s = x["t"], x["s"]
        folder = lambda p: F.regexp_replace(p["path"], r"[^/]*\z", "")
        paged = F.exists(U.params(t), lambda q: F.lower(q["k"]).isin(K.PAGINATION_KEYS))
        total = U.jaccard(address(s), address(t)) + F.when(promising(label), 0.3).otherwise(0.0) + F.when(paged, 0.3).otherwise(0.0) + F.when(folder(t) == folder(s), 0.1).otherwise(0.0)
        return F.when(t.isNull() | s.isNull(), 0.0).otherwise(total)

    return let(F.struct(U.parse(href, start).alias("t"), U.parse(start).alias("s")), value)


def element(df_columns: list[str], prefix: str = "") -> dict[str, Column]:
    """The properties of elements or links that are columns, by name."""
    names = (
        "tag", "type", "role", "text", "ariaLabel", "title", "alt", "name", "value", "className", "id", "testId", "href", "target", "hasDownloadAttr",
        "insideForm", "insideLink", "disabled", "visible", "containsMedia", "ariaControls", "ariaExpanded", "ariaSelected", "ariaHasPopup", "area",
    )
    return {n: F.col(prefix + n) for n in names if prefix + n in df_columns}


