from lodestone.operators import crawl
from lodestone.sources import controls

PAGE = """<!doctype html><html lang="it"><head><title>T</title><style>.acc { cursor: pointer; }</style></head><body><main>
<div role="tablist"><button type="button" role="tab" aria-selected="true" aria-controls="a">Panoramica</button><button type="button" role="tab" aria-selected="false" aria-controls="b">Colori</button></div>
<button type="button" class="acc" aria-expanded="false" aria-controls="acc-1">Note tecniche</button><div id="acc-1" hidden><button>inside hidden</button></div>
<button type="button" class="menu" aria-haspopup="true" aria-expanded="false">Menu</button>
<details><summary>Materiali</summary><div><button>behind</button></div></details><details open><summary>Aperto</summary><button type="button">shown</button></details>
<button type="button" aria-expanded="false" aria-controls="danger">Elimina raccolta</button>
<form id="pay"></form><button form="pay" style="cursor:pointer"><img src="p.png" width="40" height="40"></button>
<a href="next.html"><img src="t.jpg"><span>Next</span></a><span style="cursor: pointer; width: 4px; height: 4px">x</span><div tabindex="0" style="opacity:0">y</div><div tabindex="-1">z</div>
<div style="visibility:hidden"><b role="button">no</b><b role="button" style="visibility:visible">yes</b></div><button data-clicked>done</button><button disabled>off</button>
"""


def test_controls():
    found = controls.read(PAGE)
    by = {c["text"] or c["tag"]: c for c in found}
    assert list(by) == ["Panoramica", "Colori", "Note tecniche", "Menu", "Materiali", "Aperto", "shown", "Elimina raccolta", "button", "img", "Next", "x", "yes", "off"]
    assert by["Materiali"]["ariaExpanded"] == "false" and by["Aperto"]["ariaExpanded"] == "true" and by["Panoramica"]["ariaSelected"] == "true" and by["Menu"]["ariaHasPopup"] == "true"
    assert by["button"]["insideForm"] and by["button"]["containsMedia"] and not by["shown"]["insideForm"] and by["off"]["disabled"]
    assert by["Next"]["tag"] == "span" and by["img"]["insideLink"] and by["x"]["area"] == 16 and by["Menu"]["area"] == controls.ASSUMED_AREA
    numbers = [c["pos"] for c in found]
    assert numbers == sorted(set(numbers)) and all(c["last"] >= c["pos"] for c in found)
    link = next(c for c in found if c["tag"] == "a")
    assert link["last"] == link["pos"] + 2 and link["containsMedia"]


def test_inheritance_against_ancestors():
    """Pre- and post-order bounds agree with the nesting; limits hold; unclosed and implied elements are counted."""
    assert [c["pos"] for c in controls.read("<button>a</button>")] == [3]
    assert [c["pos"] for c in controls.read("<html><body><button>a</button>")] == [3] and [c["pos"] for c in controls.read("<html><head></head><body><p><button>a")] == [4]
    nested = controls.read("<body>" + "<div tabindex=0>" * 50)
    assert [(c["pos"], c["last"]) for c in nested] == [(3 + i, 52) for i in range(50)]
    assert len(controls.read("<body>" + "<button>x</button>" * 500)) == controls.MAX_CONTROLS
    assert len(controls.read("<body>" + "<p></p>" * (controls.MAX_SCANNED - 4) + "<button>x</button>" * 5)) == 1
    assert controls.read(None) == controls.read("") == [] and len(controls.read("<button>" + "ab" * 500)[0]["text"]) == 120
    assert controls.cut("🎉" * 70, 120) == "🎉" * 60 and controls.cut("a" + "🎉" * 70, 120) == "a" + "🎉" * 59


def test_judged(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x/", PAGE, 5), (2, "https://a.com/", None, 5), (1, "https://a.com/y", "<a href='//b.com/q?z=1'>more</a>", 5)], "page_id long, url string, html string, pos int")
    rows = controls.controls(pages)
    assert {r.href for r in rows.where("href <> ''").collect()} == {"https://a.com/x/next.html", "https://b.com/q?z=1"}
    verdicts = {r.text: (r.click, r.reason) for r in crawl.judged(rows.where("url = 'https://a.com/x/'")).collect()}
    assert verdicts["Elimina raccolta"] == (False, "reads as transactional or destructive") and verdicts["Colori"][0] and verdicts["Note tecniche"][0] and verdicts["Materiali"][0]
    assert not verdicts["Panoramica"][0] and not verdicts["Aperto"][0] and not verdicts["off"][0]
    assert controls.controls(pages.limit(0)).collect() == []
