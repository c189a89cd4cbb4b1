"""Cut addresses, deadlines, shipped site rules, upgrade targets, quota steps, pair bounds."""

from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import terms as T
from lodestone.functions import upgrades as G
from lodestone.functions import url as U
from lodestone.operators import index, similarity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_long_addresses_are_cut_and_inline_ones_are_not(spark):
    assert one(spark, F.length(index.fetchable(F.lit("https://cdn.example.com/" + "a" * 5000 + ".jpg")))) == K.MAX_URL
    inline = "data:image/png;base64," + "A" * 16384
    assert one(spark, index.fetchable(F.lit(inline))) == inline
    assert one(spark, index.fetchable(F.lit("data:image/png;base64," + "A" * (K.MAX_DATA_URL + 1)))) == ""
    assert one(spark, index.fetchable(F.lit("javascript:1"))) == ""
    raw = spark.range(1).selectExpr("concat('https://e.com/', repeat('b', 5000)) AS url", "map(repeat('c', 70), 2000000, concat(repeat('c', 64), 'd'), 3, 'e', 1) AS classCounts")
    row = index.sanitize(raw).first()
    assert len(row.url) == K.MAX_URL and row.class_counts == {"c" * 64: 3, "e": 1}


def test_deadlines(spark):
    now = F.lit(1_700_000_000_000)
    at = lambda q: tuple(one(spark, U.expiry(F.lit("https://e.com/a?" + q), now)))
    assert at("Expires=2030") == (True, 1893456000000)
    assert at("Expires=&Expires=1900000000") == (False, None)
    assert at("Expires=1900000000") == (True, 1900000000000)
    assert at("X-Amz-Date=&x-amz-date=20240817T120000Z&X-Amz-Expires=900") == (True, 1723896900000)
    assert at("token=opaque") == (True, None) and at("q=1") == (False, None)


def test_site_rules_are_tried_before_generic_ones(spark):
    url = "https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/X.jpg/220px-X.jpg"
    first = one(spark, G.candidates(F.lit(url), K.SITE_RULES))[0]
    assert first.url == "https://upload.wikimedia.org/wikipedia/commons/a/ab/X.jpg" and first.note.startswith("Wikimedia")
    assert one(spark, G.site(F.lit("https://cdn.shopify.com/a_large.jpg?v=1"), K.SITE_RULES))[0].url == "https://cdn.shopify.com/a.jpg?v=1"
    assert one(spark, G.site(F.lit("https://e.com/a_large.jpg"), K.SITE_RULES)) == []


def test_targets_tabs_frames_and_quota(spark):
    items = spark.createDataFrame([(1, "a", "u1"), (1, "b", "u2"), (2, "c", "u3"), (2, "d", "u4")], "tab_id int, id string, url string")
    selected = spark.createDataFrame([(1, "b")], "tab_id int, id string")
    assert sorted(r.id for r in index.upgrade_targets(items, items.where("id <> 'd'"), selected).collect()) == ["b", "c"]
    messages = spark.createDataFrame([(None, 7, 0, "s"), (3, 7, 1, "t"), (None, None, 0, "u")], "tab_id int, sender_tab_id int, frame_id int, sender_url string")
    assert sorted(r.tab_id for r in index.resolve_tab(messages).collect()) == [3, 7]
    assert [r.page_url for r in index.top_frame(index.resolve_tab(messages)).collect()] == ["s"]
    heavy = items.selectExpr("*", "array(named_struct('tag', repeat('x', 500), 'classes', array('y'))) AS structural_path", "map('a', 1) AS class_counts", "0 AS repeat_depth", "true AS in_repeated_group")
    steps = [index.degraded(heavy, heavy, quota) for quota in (100_000, 3_000, 1_000, 10)]
    assert [s for s, *_ in steps] == ["whole", "no_history", "trimmed", "error"]
    assert steps[1][2].count() == 0 and steps[2][1].where("size(structural_path) = 0").count() == 4


def test_bound_is_never_below_the_score(spark):
    urls = [f"https://{h}/m/{d}/{n}.{e}" for h in ("a.e.com", "www.a.e.com", "b.e.com", "x.org") for d in ("p", "q/2020") for n in ("one-two", "one-3") for e in ("jpg", "mp4")] + ["data:image/png;base64,AA", "", "blob:x"]
    path = "array(named_struct('tag', 'DIV', 'classes', array('k')), named_struct('tag', 'ul', 'classes', array('z')))"
    rows = spark.createDataFrame([(1, i, u, (i % 3) * 100.0, (i % 4) * 50.0) for i, u in enumerate(urls)], "tab_id int, seq int, url string, width double, height double")
    rows = rows.selectExpr("*", "seq AS item", "CASE WHEN seq % 5 = 0 THEN 'image/webp' ELSE '' END AS mime_type", f"CASE WHEN seq % 2 = 0 THEN {path} END AS path")
    items = similarity.with_features(rows, path="path")
    both = items.alias("l").join(items.alias("r"), F.col("l.seq") < F.col("r.seq"))
    assert both.where(T.at_most(F.col("l.f"), F.col("r.f")) < T.score(F.col("l.f"), F.col("r.f")) - 1e-9).count() == 0
