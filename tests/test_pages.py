"""Statute and listing pages: nested tags, decoys, missing parts."""

import datetime as dt

from pyspark.sql import functions as F

from statuta.sources import markup, pages

BODY = """<div id="bodyContentTOP"><input type="hidden" value="L7" id="lsId"/><input id="lsNm" type="hidden" value="A &amp; B법"/><input id="efYd" value="20240102"/><input id="ancYd" value="bad"/>
<div id="conScroll"><p class="gtit">제1장 총칙</p><a name="J1:0" class="x"></a><div class="pgroup"><div class="lawcon"><p class="pty1_p4"><span class="bl"><label>제1조(목적)</label></span> 이 법은 <a href="#">목적</a>을 정한다.</p><p> </p><p class="pty1_de2">1. 첫째 &lt;호&gt;</p></div></div>
<p class="gtit">제2장</p><a name="J2:3"></a><div class="pgroup"><div class="lawcon"><p><span class="bl"><label>제2조의3(현행)</label></span> 현행 본문</p></div></div>
<div class="pgroup babl"><div class="lawcon"><p><span class="bl">제2조의3(예정)</span> <span style="color: rgb(255, 0, 0)">개정</span> 본문</p><p>[시행일: 2025. 3. 4.] 제2조의3</p></div></div>
<a name="J3:0"></a><div class="pgroup"><p>제3조 삭제</p></div><div class="pgroup babl"><p>날짜 없음</p></div></div>
<div id="arDivArea"><a name="arArea"></a><a name="J99:0"></a><a name="J12345"></a><div class="pgroup"><p class="pty3_dep1">제1조(시행일)</p><p class="pty3">부칙 <em>제1호</em></p><p>다른 것</p></div><a name="J777"></a><div class="pgroup"><p class="pty3">부칙 둘</p></div></div></div>"""


def test_statute_page(spark):
    rows = spark.createDataFrame([(1, BODY), (2, None), (3, "<p>x</p>")], "page_id long, html string")
    found = {r["page_id"]: r for r in pages.statutes(rows).collect()}
    page = found[1]
    assert (page["law_id"], page["law_name"], page["effective_date"], page["promulgation_date"], page["promulgation_no"]) == ("L7", "A & B법", dt.date(2024, 1, 2), None, "")
    one, two, three = page["articles"]
    assert (one["jo_no"], one["jo_br_no"], one["title"], one["upcoming"]) == ("1", "0", "제1조(목적)", False)
    assert one["body"] == "제1조(목적) 이 법은 목적 을 정한다.\n1. 첫째 <호>"
    assert (two["jo_br_no"], two["body"], two["upcoming_title"], two["upcoming_date"]) == ("3", "제2조의3(현행) 현행 본문", "제2조의3(예정)", dt.date(2025, 3, 4))
    assert two["upcoming_body"] == "제2조의3(예정) 개정 본문\n[시행일: 2025. 3. 4.] 제2조의3"
    assert three["body"] == "제3조 삭제" and three["upcoming"] and three["upcoming_date"] is None
    assert [(a["id"], a["body"]) for a in page["addenda"]] == [("12345", "부칙 제1호\n제1조(시행일)"), ("777", "부칙 둘")]
    assert found[2]["articles"] == [] and found[3]["law_id"] == "" and found[3]["addenda"] == []
    items = {r["id"]: r for r in pages.statute_items(pages.statutes(rows)).collect()}
    assert set(items) == {"L7-1-0@2024-01-02", "L7-2-3@2024-01-02", "L7-2-3@2025-03-04", "L7-3-0@2024-01-02", "L7-ar-12345", "L7-ar-777"}
    assert items["L7-2-3@2024-01-02"]["superseded_date"] == dt.date(2025, 3, 4) and items["L7-2-3@2025-03-04"]["supersedes"] == "law:L7-2-3@2024-01-02"
    assert items["L7-3-0@2024-01-02"]["superseded_date"] is None and items["L7-ar-777"]["title"] == "A & B법 부칙"


def test_listing_table(spark):
    decoy = '<table><tr><th scope="col">부처</th></tr><tr><td>1</td></tr></table>'
    real = '<table class="t"><tr><th scope="col"> 번호 </th><th scope="col">법령명</th><th scope="col">공포일자</th></tr><tr><td>2</td><td><a>나 <b>법</b></a><img src="u" alt="앞으로 시행될 법령"></td><td>2024. 1. 1.</td><td>more</td></tr><tr><td>1</td><td>가법</td><td> </td></tr><tr><td> </td></tr></table>'
    rows = spark.createDataFrame([(1, decoy + real), (2, decoy), (3, None)], "page_id long, html string")
    found = {r["cells"]["번호"]: (r["page_id"], r["cells"], r["upcoming"]) for r in pages.listing_tables(rows).collect()}
    assert found == {"1": (1, {"번호": "1", "법령명": "가법"}, False), "2": (1, {"번호": "2", "법령명": "나 법", "공포일자": "2024. 1. 1."}, True)}


def test_crawl_ends_at_a_date_or_a_year(spark):
    day = dt.date
    rows = spark.createDataFrame([("s", 1, day(2024, 1, 1)), ("s", 2, None), ("s", 3, day(1999, 1, 1)), ("s", 4, day(2024, 1, 1)), ("t", 1, None)], "site string, page int, newest date")
    assert sorted((r["site"], r["page"]) for r in pages.fresh_pages(rows).collect()) == [("s", 1), ("s", 2), ("t", 1)]
    assert pages.fresh_pages(rows, oldest_year=1990).count() == 5


def test_blocks_keep_text_behind_inline_tags(spark):
    html = '<script>var t="</p><p>no";</script><h1>A &amp; B</h1><p class="x"><b>bold</b> rest<br>more<p>next</p><div>out</div>'
    found = [(r["tag"], r["text"]) for r in pages.blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_no").collect()]
    assert found == [("h1", "A & B"), ("p", "bold rest more"), ("p", "next")]


def test_nesting_quotes_and_references(spark):
    html = """<INPUT type=hidden id=lsId value='L9'><input id='lsNm' value="가&middot;나 &#xBC95;"><input ID=efYd value=20240102>
<a name=J1:0></a><ul><li>x</li></ul><div class='x pgroup'><div class="lawcon"><p>one&hellip;</p><div><div><table><tr><td><p>in a table&nbsp;</p></td></tr></table></div></div><p>after</p><!-- <p>no</p> --><script>'</p>'</script></div></div>
<div class='pgroup babl'><div><p>new <b class="bl">제1조</b></p><p>[시행 2030. 1. 1.] old note</p><p>[시행일:&nbsp;2031. 2. 3.]</p></div></div>
<a name="J2:0"></a><div class="pgroup"><p>two</p></div><br><div class="pgroup babl"><p>not directly behind</p></div>
<a name="J3:0"></a><div class="pgroup"><p>three</p></div><div class="babl pgroup"><p>[시행 2030. 1. 1.]</p></div>
<a name="J4:0"></a><p>no group behind it</p>"""
    rows = spark.createDataFrame([(1, html), (2, "<div>" * 5000 + "<p id='lsId'>deep"), (3, "</div></p>< & <b")], "page_id long, html string")
    found = {r["page_id"]: r for r in pages.statutes(rows).collect()}
    page = found[1]
    assert (page["law_id"], page["law_name"], page["effective_date"]) == ("L9", "가·나 법", dt.date(2024, 1, 2))
    one, two, three = page["articles"]
    assert one["body"] == "one…\nin a table\nafter" and one["upcoming_title"] == "제1조"
    assert one["upcoming_date"] == dt.date(2031, 2, 3) and one["upcoming_body"].startswith("new 제1조\n[시행 2030. 1. 1.] old note\n[시행일: 2031.")
    assert two["body"] == "two" and not two["upcoming"]
    assert three["upcoming"] and three["upcoming_date"] is None
    assert found[2]["articles"] == found[3]["articles"] == [] and found[2]["law_id"] == ""


def test_nested_listing_tables(spark):
    inner = "<table><tr><th scope=col>번호</th><th scope='col'>법령명</th></tr><tr><td>1</td><td>가<table><tr><th scope=col>x</th></tr><tr><td>9</td></tr></table></td></tr><tr><td>2<td>open</table>"
    rows = spark.createDataFrame([(1, f"<table><tr><td>{inner}</td></tr></table>")], "page_id long, html string")
    found = {r["cells"]["번호"]: r["cells"]["법령명"] for r in pages.listing_tables(rows).collect() if "법령명" in r["cells"]}
    assert found["1"].startswith("가") and len(found) >= 1


def test_left_listing(spark):
    row = lambda k, name, day: f"<li id='liBgcolor{k}'><a title='{name}\n[시행 {day}] [법률 제1호, 1999. 9. 9.]'><span class=tx>{k}. {name}</span><span class='tx2 y'>[시행 {day}] [법률 제1호, 1999. 9. 9., 일부개정]</span></a><ul><li id=other><a title=no>x</a></li></ul></li>"
    html = f"<a title=outside></a><div id=listDiv><ul>{row(0, '가 &amp; 법', '2023. 9. 14.')}<li id=liBgcolor1><a>untitled</a></li>{row(2, '나법', '2099. 1. 1.')}{row(3, '다법', '2024. 13. 1.')}</ul></div>"
    found = pages.left_listing(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), F.lit("2024-01-01").cast("date")).collect()
    assert [tuple(r)[1:] for r in found] == [(1, "liBgcolor0", "가 & 법", dt.date(2023, 9, 14), False), (3, "liBgcolor2", "나법", dt.date(2099, 1, 1), True), (4, "liBgcolor3", "다법", None, False)]


def test_statute_pages_are_read_once(spark):
    """Articles, upcoming versions and addenda come from one reading of the pages (three before)."""
    found = pages.statute_items(pages.statutes(spark.createDataFrame([(1, "<p>x</p>")], "page_id bigint, html string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_tree_is_released():
    """A released tree needs no collector, so trees do not pile up."""
    import gc

    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(x, markup.Element) for x in gc.get_objects())
        root = markup.tree("<div><p>a<b>c</b></p></div>" * 50)
        root.release()
        del root
        assert sum(isinstance(x, markup.Element) for x in gc.get_objects()) == before
    finally:
        gc.enable()
