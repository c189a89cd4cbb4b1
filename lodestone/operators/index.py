"""The index of a tab: sanitised sightings merged by the dedupe key of their URL, with caps, statuses and display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import url as U
from lodestone.functions.core import array_of, let, text
from lodestone.storage import written

_SCHEMES = r"(?i)\A(?:https?|data|blob):"


def fetchable(url: Column, synthetic: tuple[str, ...] = ()) -> Column:
    """The URL if its scheme may be fetched or is one of the synthetic ones; else empty. A data: URL is its own bytes, so one
    that is too long goes; others are cut."""
    url = F.trim(text(url))
    url = F.when(M.is_data(url), F.when(F.length(url) <= K.MAX_DATA_URL, url).otherwise("")).otherwise(F.substring(url, 1, K.MAX_URL))
    ok = url.rlike(_SCHEMES)
    for scheme in synthetic:
        ok = ok | F.lower(url).startswith(f"{scheme.lower()}:")
    return F.when(ok, url).otherwise("")


def absolute(url: Column, base: Column) -> Column:
    """The scanner's gate: inline URLs pass, others are resolved and must be http(s); empty and bare fragments go."""
    trimmed = F.trim(text(url))
    p = U.parse(trimmed, base)
    return F.when((trimmed == "") | trimmed.startswith("#"), "").when(trimmed.rlike(r"(?i)\A(?:data|blob):"), trimmed).when(U.is_http(p), U.href(p)).otherwise("")


def _size(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")), 0.0).otherwise(v)


def capped_counts(counts: Column, most: int = 64) -> Column:
    """Names cut to ``most`` characters, counts to a million; of names that become equal the last count stays."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct(F.substring(e["key"], 1, most).alias("key"), F.least(e["value"], F.lit(1_000_000)).alias("value")))
    last = lambda es: F.filter(es, lambda e, i: F.array_position(F.slice(F.transform(es, lambda x: x["key"]), i + 2, F.size(es)), e["key"]) == 0)
    return F.map_from_entries(let(entries, last))


def sanitize(raw: DataFrame, synthetic: tuple[str, ...] = ()) -> DataFrame:
    """Every known field coerced to its type and capped; missing columns get their defaults; rows without a fetchable URL go."""
    have = {c.lower(): c for c in raw.columns}
    col = lambda name, kind="string": F.col(have[name.lower()]) if name.lower() in have else F.lit(None).cast(kind)
    cap = lambda name, n: F.substring(text(col(name).cast("string")), 1, n)
    flag = lambda name: F.coalesce(col(name, "boolean").cast("boolean"), F.lit(False))
    one_of = lambda name, values, default: F.when(col(name).isin(values), col(name)).otherwise(default)
    path = col("structuralPath", "array<struct<tag:string,classes:array<string>>>")
    counts = col("classCounts", "map<string,int>")
    size = col("bytes", "double").try_cast("double")
    node = lambda x: F.struct(F.lower(F.substring(text(x["tag"]), 1, 32)).alias("tag"), F.transform(F.slice(F.coalesce(x["classes"], array_of([])), 1, 8), lambda c: F.substring(text(c), 1, 64)).alias("classes"))
    kept = F.map_from_entries(F.slice(F.map_entries(F.map_filter(F.coalesce(counts, F.create_map().cast("map<string,int>")), lambda k, v: v >= 0)), 1, 32))
    depth = col("repeatDepth", "int").try_cast("int")
    out = raw.select(
        *(F.col(c) for c in ("tab_id", "seq") if c in raw.columns),
        fetchable(col("url"), synthetic).alias("url"),
        cap("mimeType", 128).alias("mime_type"), cap("kind", 16).alias("kind"),
        *(_size(col(n, "double")).alias(a) for n, a in (("width", "width"), ("height", "height"), ("renderedWidth", "rendered_width"), ("renderedHeight", "rendered_height"))),
        F.when(size.isNull(), None).otherwise(_size(size)).alias("bytes"),
        one_of("source", K.SOURCES, "dom").alias("source"), one_of("status", K.STATUSES, "referenced").alias("status"),
        cap("elementId", 64).alias("element_id"),
        F.transform(F.slice(F.coalesce(path, F.array().cast("array<struct<tag:string,classes:array<string>>>")), 1, 16), node).alias("structural_path"),
        capped_counts(kept).alias("class_counts"),
        flag("inRepeatedGroup").alias("in_repeated_group"), F.when(depth >= 0, depth).otherwise(-1).alias("repeat_depth"),
        flag("harBody").alias("har_body"), flag("poster").alias("poster"),
        fetchable(col("upgradeUrl"), synthetic).alias("upgrade_url"), fetchable(col("previewUrl"), synthetic).alias("preview_url"),
        cap("upgradeNote", 128).alias("upgrade_note"), cap("protectedReason", 128).alias("protected_reason"),
        cap("frameUrl", K.MAX_URL).alias("frame_url"), cap("pageUrl", K.MAX_URL).alias("page_url"), cap("frameOrigin", 256).alias("frame_origin"),
        cap("alt", 256).alias("alt"), cap("synthetic", 16).alias("synthetic"), cap("origin", 64).alias("origin"),
        _size(col("timestamp", "long")).cast("long").alias("timestamp"),
    )
    return out.where("url <> ''")


def prepared(sightings: DataFrame) -> DataFrame:
    """kind, rejection reason and key of each sighting; the others keep their columns.

    An item is seen many times with the same facts, and addresses cost most to read: the three are made once per different
    (url, mime_type, kind, size) and joined back, and so are the facts themselves, which a sighting need not carry to the join.
    The key, which costs most of all, is made once per address. All come out of generators, so that a filter stays above them.
    """
    facts = ["url", "mime_type", "kind", "width", "height", "bytes"]

    def found(x: Column) -> Column:
        kind = F.when(text(x["kind"]) != "", x["kind"]).otherwise(M.classify(x["url"], x["mime_type"]))
        reason = M.rejection_reason(x["url"], x["width"], x["height"], x["bytes"])
        return F.struct(kind.alias("kind"), reason.alias("rejection"))

    # nulls are facts too, so the join is on values that are never null
    print_ = F.unhex(F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256)).alias("_facts")
    seen = sightings.select("*", print_)
    kept = [c for c in facts if c != "kind"]
    known = seen.groupBy("_facts").agg(F.first(F.struct(*facts)).alias("x")).select("_facts", F.col("x.url").alias("url"), "x")
    same = Window.partitionBy("url").orderBy("_facts")
    key = F.when(F.col("nth") == 1, U.normalize_url(F.col("url"))).alias("key")
    known = known.withColumn("nth", F.row_number().over(same)).select("_facts", "url", "x", F.inline(F.array(F.struct(key))))
    known = known.withColumn("normalized_url", F.first("key").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    known = known.select("_facts", *(F.col(f"x.{c}").alias(c) for c in kept), "normalized_url", F.inline(F.array(let(F.col("x"), found))))
    joined = seen.drop(*facts).join(known, "_facts")
    return joined.select(*(c for c in sightings.columns if c != "kind"), "kind", "rejection", "normalized_url")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("kind <> '' and rejection = '' and normalized_url <> ''")


def merged_status(statuses: Column, sources: Column, n: Column) -> Column:
    """The status after all sightings, from the sets of their statuses and sources; independent of their order."""
    has = lambda s: F.array_contains(statuses, s)
    net = F.arrays_overlap(sources, array_of(["net", "main", "har"]))
    alone = F.get(statuses, 0)
    several = (
        F.when(has("protected"), "protected")
        .when(has("confirmed") | (F.array_contains(sources, "dom") & net), "confirmed")
        .when(net, "background")
        .when(has("unavailable"), "unavailable")
        .otherwise("referenced")
    )
    return F.when(n == 1, F.coalesce(F.when(alone != "", alone), F.when(F.array_contains(sources, "dom"), "referenced").otherwise("background"))).otherwise(several)


FIRST_NON_EMPTY = ("mime_type", "element_id", "alt", "upgrade_url", "upgrade_note", "frame_url", "frame_origin", "protected_reason", "synthetic")
LARGEST = ("width", "height", "rendered_width", "rendered_height")
FROM_FIRST = ("url", "kind", "source", "poster")


def merge(rows: DataFrame, protected_tabs: DataFrame | None = None) -> DataFrame:
    """One row per (tab_id, normalized_url) of accepted sightings, in the order of seq. All aggregates are partial per task.

    protected_tabs (tab_id): tabs that asked for a key system; their video, audio and streams become protected.
    """
    have = set(rows.columns)
    first = lambda name, where: F.min_by(F.when(where, F.col(name)), F.when(where, F.col("seq"))).alias(name)
    agg = [first(c, F.lit(True)) for c in FROM_FIRST if c in have]
    agg += [first(c, text(F.col(c)) != "") for c in FIRST_NON_EMPTY if c in have]
    agg += [F.max(c).alias(c) for c in LARGEST if c in have]
    agg.append(first("bytes", F.col("bytes").isNotNull()))
    if "structural_path" in have:
        unit = F.struct(*(c for c in ("structural_path", "in_repeated_group", "repeat_depth", "class_counts") if c in have))
        there = F.size("structural_path") > 0
        agg.append(F.min_by(F.when(there, unit), F.when(there, F.col("seq"))).alias("structure"))
    if "har_body" in have:
        agg.append(F.bool_or("har_body").alias("har_body"))
    if "preview_url" in have:
        some = F.col("preview_url") != ""
        agg.append(F.max_by(F.when(some, F.col("preview_url")), F.when(some, F.col("seq"))).alias("preview_url"))
    if "gen" in have:
        agg.append(F.max_by("gen", "seq").alias("gen"))
    seen = [F.min(F.when(F.col("source") == s, F.col("seq"))).alias(f"seen_{s}") for s in K.SOURCES]
    agg += [*seen, F.collect_set("status").alias("statuses"), F.min("seq").alias("first_seq"), F.count("*").alias("sightings")]
    out = rows.groupBy("tab_id", "normalized_url").agg(*agg)
    order = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"seen_{s}").alias("seq"), F.lit(s).alias("source")) for s in K.SOURCES)), lambda x: x["seq"].isNotNull()))
    out = out.withColumn("sources", F.transform(order, lambda x: x["source"]))
    out = out.withColumn("status", merged_status(F.col("statuses"), F.col("sources"), F.col("sightings")))
    if protected_tabs is not None:
        out = protect(out, protected_tabs)
    if "structural_path" in have:
        out = out.select("*", *(F.col(f"structure.{c}").alias(c) for c in ("structural_path", "in_repeated_group", "repeat_depth", "class_counts") if c in have)).drop("structure")
    return out.drop("statuses", *(f"seen_{s}" for s in K.SOURCES))


def protect(items: DataFrame, protected_tabs: DataFrame) -> DataFrame:
    """Marks the audio, video and streams of the given tabs; marking is all that is ever done with them."""
    marked = protected_tabs.select("tab_id").distinct().withColumn("asked", F.lit(True))
    status = F.when(F.col("asked") & F.col("kind").isin("video", "audio", "stream"), "protected").otherwise(F.col("status"))
    return items.join(marked, "tab_id", "left").withColumn("status", status).drop("asked")


def capped(items: DataFrame, most: int | None = K.MAX_ITEMS_PER_TAB, data_budget: int = K.DATA_URI_TAB_BUDGET) -> DataFrame:
    """The first ``most`` items of each tab (all if None), in order of first sight, with id and ``truncated``. data: keys beyond the tab's
    budget are refused as they come: a refused one takes nothing of it, so a later, smaller one may fit. Four reads of the items
    make the result, so they are written first: else each would merge all sightings anew."""
    items = written(items)
    data = items.where(M.is_data(F.col("normalized_url"))).groupBy("tab_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", F.length("normalized_url").alias("size")))).alias("all"))
    kind = items.schema["first_seq"].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))
    fits = lambda a, x: a["used"] + x["size"] <= data_budget
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["size"]).cast("long").alias("used"), F.concat(a["kept"], F.array(x["first_seq"])).alias("kept"))).otherwise(a)
    kept = data.select("tab_id", F.explode(F.aggregate("all", zero, step)["kept"]).alias("first_seq"))
    is_data = M.is_data(F.col("normalized_url"))
    fitting = items.where(~is_data).unionByName(items.where(is_data).join(kept, ["tab_id", "first_seq"], "left_semi"))
    place = F.row_number().over(Window.partitionBy("tab_id").orderBy("first_seq"))
    n = items.groupBy("tab_id").agg(F.count("*").alias("all_items"))
    out = fitting.withColumn("place", place)
    out = out.where(F.col("place") <= most) if most is not None else out
    shown = F.count("*").over(Window.partitionBy("tab_id"))
    return out.join(n, "tab_id").withColumns({"id": F.concat_ws("-", F.col("tab_id").cast("string"), F.col("place").cast("string")), "truncated": shown < F.col("all_items")}).drop("place", "all_items")


def status_rank(status: Column) -> Column:
    out = F.lit(9)
    for i, s in reversed(list(enumerate(K.STATUSES))):
        out = F.when(status == s, i).otherwise(out)
    return out


def display_order(items: DataFrame) -> DataFrame:
    """items with display: their place in their tab, by status and first sight."""
    return items.withColumn("display", F.row_number().over(Window.partitionBy("tab_id").orderBy(status_rank(F.col("status")), "first_seq")))


def counters(rows: DataFrame) -> DataFrame:
    """tab_id, added, updated, rejected of prepared sightings."""
    ok = (F.col("kind") != "") & (F.col("rejection") == "") & (F.col("normalized_url") != "")
    rejected = F.count_if((F.col("kind") != "") & (F.col("rejection") != ""))
    return rows.groupBy("tab_id").agg(F.count_distinct(F.when(ok, F.col("normalized_url"))).alias("added"), F.count_if(ok).alias("seen"), rejected.alias("rejected")).select("tab_id", "added", (F.col("seen") - F.col("added")).alias("updated"), "rejected")


def filtered(items: DataFrame, kinds: list[str], confirmed_only: bool = False, min_side: float = 0, min_kb: float = 0, needle: str = "") -> DataFrame:
    """The panel's filter."""
    needle = needle.strip().lower()
    keep = F.col("kind").isin(kinds) & (F.greatest("width", "height") >= min_side) & (F.coalesce("bytes", F.lit(0)) >= min_kb * 1024)
    if confirmed_only:
        keep = keep & (F.col("status") == "confirmed")
    return items.where(keep & F.lower("url").contains(needle) if needle else keep)


def downloadable(items: DataFrame) -> DataFrame:
    return items.where(~F.col("status").isin("protected", "unavailable") & (F.col("kind") != "stream"))


def similar_pool(items: DataFrame) -> DataFrame:
    return items.where((F.col("status") != "protected") & (F.col("kind") != "stream"))


def pack_path(path: Column) -> Column:
    return F.transform(path, lambda n: F.concat_ws(" ", F.array(n["tag"]), n["classes"]))


def unpack_path(packed: Column) -> Column:
    return F.transform(packed, lambda s: F.struct(F.substring_index(s, " ", 1).alias("tag"), F.slice(F.split(s, " "), 2, 100).alias("classes")))


def pack_counts(counts: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), " ")


def unpack_counts(packed: Column) -> Column:
    words = F.filter(F.split(text(packed), " "), lambda x: x != "")
    evens = F.filter(words, lambda x, i: i % 2 == 0)
    odds = F.transform(F.filter(words, lambda x, i: i % 2 == 1), lambda x: x.try_cast("int"))
    return F.when(F.size(words) > 0, F.map_from_arrays(evens, odds))


def lighten(items: DataFrame) -> DataFrame:
    """History rows: without their structure."""
    return items.withColumns({"structural_path": F.array().cast("array<struct<tag:string,classes:array<string>>>"), "class_counts": F.create_map().cast("map<string,int>"), "repeat_depth": F.lit(-1), "in_repeated_group": F.lit(False)})


def lookup(live: DataFrame, history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (tab_id, key) the first item, live before history, whose key, id or URL it is."""
    both = live.withColumn("old", F.lit(0)).unionByName(history.withColumn("old", F.lit(1)), allowMissingColumns=True)
    by = both.select("tab_id", F.explode(F.array_distinct(F.array("normalized_url", "id", "url"))).alias("key"), "old", "first_seq", F.struct(*[c for c in both.columns if c != "tab_id"]).alias("item"))
    hit = wanted.select("tab_id", "key").distinct().join(by, ["tab_id", "key"], "left")
    return hit.groupBy("tab_id", "key").agg(F.min_by("item", F.struct("old", "first_seq")).alias("item"))


def totals(items: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Items and bytes of each tab; of a selection (tab_id, id) the downloadable ones, by their proven size where known."""
    if selected is None:
        return items.groupBy("tab_id").agg(F.count("*").alias("items"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
    chosen = downloadable(items).join(selected, ["tab_id", "id"], "left_semi")
    size = F.coalesce(F.col("upgrade_bytes"), F.col("bytes"), F.lit(0)) if "upgrade_bytes" in items.columns else F.coalesce("bytes", F.lit(0))
    return chosen.groupBy("tab_id").agg(F.count("*").alias("items"), F.sum(size).alias("bytes"))


def upgrade_targets(items: DataFrame, shown: DataFrame, selected: DataFrame) -> DataFrame:
    """What a check for upgrades is asked for: a tab's selected ids (tab_id, id), or all shown items of a tab that selects none."""
    chosen = items.join(selected.select("tab_id", "id").distinct(), ["tab_id", "id"], "left_semi")
    return chosen.unionByName(shown.select(*items.columns).join(selected.select("tab_id").distinct(), "tab_id", "left_anti"))


def resolve_tab(messages: DataFrame) -> DataFrame:
    """tab_id: the one that a message names, else its sender's; messages of no tab go."""
    return messages.withColumn("tab_id", F.coalesce("tab_id", "sender_tab_id")).where("tab_id is not null")


def top_frame(messages: DataFrame) -> DataFrame:
    """Crawl messages count from the top frame alone, and their page is the sender's."""
    return messages.where("frame_id = 0").withColumn("page_url", F.col("sender_url"))


def degraded(items: DataFrame, history: DataFrame, quota: int) -> tuple[str, DataFrame, DataFrame]:
    """(step, items, history) of an index that must fit ``quota`` bytes of JSON: ``whole``, then ``no_history``, then
    ``trimmed`` (items without their structure), else ``error``. The sizes are one aggregate each."""
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]
    own = size(items)
    if own + size(history) <= quota:
        return "whole", items, history
    none = history.limit(0)
    if own <= quota:
        return "no_history", items, none
    light = lighten(items)
    return ("trimmed" if size(light) <= quota else "error"), light, none
