"""Proof of resolution upgrades against probe results, and merging of items that turn out to be one asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import upgrades as G
from lodestone.functions.core import text
from lodestone.storage import written


def checkable(items: DataFrame) -> DataFrame:
    """Items an upgrade can be looked for: no streams, nothing protected or inline, none checked before."""
    out = items.where((F.col("kind") != "stream") & (F.col("status") != "protected") & ~M.is_data(F.col("url")) & ~M.is_blob(F.col("url")))
    return out.where(~F.coalesce("upgrade_checked", F.lit(False))) if "upgrade_checked" in items.columns else out


def exploded(items: DataFrame, rules: list[dict] | None = None, most: int = K.MAX_UPGRADE_CANDIDATES) -> DataFrame:
    """A row per candidate: the item's columns, pos, candidate, verify, note."""
    return checkable(items).select("*", F.posexplode(F.slice(G.candidates(F.col("url"), rules), 1, most)).alias("pos", "c")).select("*", F.col("c.url").alias("candidate"), "c.verify", "c.note").drop("c")


def verified(items: DataFrame, probes: DataFrame, rules: list[dict] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Per checkable item (tab_id, item) its first proven candidate: upgrade_url, upgrade_note, upgrade_bytes; null if none.

    probes: url, ok, bytes, mime_type. A probe must have answered, be media if it names a type, and not be smaller than the
    item where both sizes are known. A rule that needs no proof wins without a probe. candidates: the rows of exploded(), where
    they are at hand.
    """
    rows = (exploded(items, rules) if candidates is None else candidates).alias("i").join(probes.select(F.col("url").alias("candidate"), "ok", F.col("bytes").alias("probe_bytes"), F.col("mime_type").alias("probe_mime")), "candidate", "left")
    media = (text(F.col("probe_mime")) == "") | (M.kind_from_mime(F.col("probe_mime")) != "")
    large = F.col("probe_bytes").isNull() | F.col("bytes").isNull() | (F.col("probe_bytes") >= F.col("bytes"))
    good = ~F.col("verify") | (F.coalesce("ok", F.lit(False)) & media & large)
    best = F.min_by(F.struct(F.col("candidate").alias("upgrade_url"), F.col("note").alias("upgrade_note"), F.when(F.col("verify"), F.col("probe_bytes")).alias("upgrade_bytes")), "pos")
    found = rows.where(good).groupBy("tab_id", "item").agg(best.alias("u")).select("tab_id", "item", "u.*")
    return checkable(items).select("tab_id", "item").join(found, ["tab_id", "item"], "left").withColumn("upgrade_verified", F.col("upgrade_url").isNotNull())


def batch_counters(items: DataFrame, checked: DataFrame, collapsed: DataFrame) -> DataFrame:
    """tab_id, checked, upgraded, collapsed."""
    a = checked.groupBy("tab_id").agg(F.count("*").alias("checked"), F.count_if("upgrade_verified").alias("upgraded"))
    b = collapsed.groupBy("tab_id").agg(F.sum("merged_duplicates").alias("collapsed"))
    return a.join(b, "tab_id", "left").withColumn("collapsed", F.coalesce("collapsed", F.lit(0)))


def effective_url(items: DataFrame) -> DataFrame:
    return items.withColumn("effective_url", F.when(F.col("upgrade_verified") & (text(F.col("upgrade_url")) != ""), F.col("upgrade_url")).otherwise(F.col("url")))


def collapse(items: DataFrame) -> DataFrame:
    """One row per (tab_id, effective URL): the survivor has structure if any does, then was seen first. It takes the union of
    sources, the first known upgrade size, the first known dimensions if it has none, and counts what it absorbed."""
    rows = written(effective_url(items))  # read twice below
    has = F.size("structural_path") > 0 if "structural_path" in items.columns else F.lit(False)
    rank = Window.partitionBy("tab_id", "effective_url").orderBy(F.desc(has), "first_seq")
    rows = rows.withColumn("place", F.row_number().over(rank))
    sized, later = F.col("width") > 0, F.col("place") > 1
    folded = rows.groupBy("tab_id", "effective_url").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "sources"))), lambda x: x["sources"]))).alias("all_sources"),
        F.min_by(F.when(F.col("upgrade_bytes").isNotNull(), F.col("upgrade_bytes")), F.when(F.col("upgrade_bytes").isNotNull(), F.col("place"))).alias("any_bytes"),
        F.min_by(F.struct("width", "height"), F.when(sized & later, F.col("place"))).alias("any_size"),
        (F.count("*") - 1).alias("merged_duplicates"),
    )
    out = rows.where("place = 1").join(folded, ["tab_id", "effective_url"])
    fill = lambda c: F.when(~(F.col("width") > 0) & F.col("any_size").isNotNull(), F.col(f"any_size.{c}")).otherwise(F.col(c))
    return out.select(
        *(c for c in items.columns if c not in ("sources", "width", "height", "upgrade_bytes")), F.col("all_sources").alias("sources"), fill("width").alias("width"), fill("height").alias("height"),
        F.coalesce("upgrade_bytes", "any_bytes").alias("upgrade_bytes"), "effective_url", "merged_duplicates",
    )


UPGRADE = {"upgrade_checked": "boolean", "upgrade_verified": "boolean", "upgrade_url": "string", "upgrade_note": "string", "upgrade_bytes": "long"}


def verify_batch(items: DataFrame, probes: DataFrame, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the index after a check of all items that were not checked before, counters of the check).

    The five UPGRADE fields are written back: of the items in turn all become checked, those without a proven candidate
    (streams, protected and inline ones among them) with empty fields; items that were checked keep theirs, and columns that
    are missing count as never written. Then items with one effective URL are folded. Counters: tab_id, checked, upgraded,
    collapsed. Of repeated (tab_id, item) rows each is checked; an index has no row without a url, and such rows leave.
    """
    have = items.select("*", *(F.lit(None).cast(t).alias(c) for c, t in UPGRADE.items() if c not in items.columns))
    had = F.coalesce("upgrade_checked", F.lit(False))
    found = verified(have.where(~had).drop(*(c for c in UPGRADE if c != "upgrade_checked")), probes, rules).dropDuplicates(["tab_id", "item"])
    found = found.select("tab_id", "item", F.struct("upgrade_verified", "upgrade_url", "upgrade_note", "upgrade_bytes").alias("new"))
    rows = have.join(found, ["tab_id", "item"], "left")
    fresh = {
        "upgrade_checked": F.lit(True), "upgrade_verified": F.coalesce("new.upgrade_verified", F.lit(False)), "upgrade_url": text(F.col("new.upgrade_url")), "upgrade_note": text(F.col("new.upgrade_note")),
        "upgrade_bytes": F.col("new.upgrade_bytes").cast("long"),
    }
    written_back = rows.withColumn("turn", ~had).select(*(c for c in items.columns if c not in UPGRADE), "turn", *(F.when(F.col("turn"), v).otherwise(F.col(c)).alias(c) for c, v in fresh.items()))
    folded = collapse(written_back.drop("turn"))
    counts = written_back.groupBy("tab_id").agg(F.count_if("turn").alias("checked"), F.count_if(F.col("turn") & F.col("upgrade_verified")).alias("upgraded"))
    counters = counts.join(folded.groupBy("tab_id").agg(F.sum("merged_duplicates").alias("collapsed")), "tab_id")
    return folded, counters
