"""Trees, tag soup, marked agendas, custom adapters and press coverage on literal rows."""

import datetime
import json

import pyarrow as pa
import pyarrow.parquet as pq

from quorumlake.operators import coverage as P
from quorumlake.sources import adapters, listings, trees


def test_a_tree_of_any_depth(spark):
    leaf = {"id": 9, "agendaObjectItemNumber": "9", "name": "<i>Deep</i> &amp; down", "description": "<p>" + "x" * 400}
    for k in range(120):
        leaf = {"isSection": True, "name": f"level {k}", "children": [leaf]}
    tree = [
        {"name": "Header", "childItems": [{"itemNumber": "1", "itemName": "One"}, {"agendaObjectItemNumber": "2", "name": "Two", "childItems": [{"name": "Two A"}, {"name": ""}]}]},
        leaf,
        {"outlineNumber": "7", "childItems": []},
    ]
    docs = spark.createDataFrame([(1, json.dumps(tree)), (2, "[]"), (3, "no json"), (4, None)], "meeting_id long, tree string")
    got = [tuple(r) for r in trees.flatten_items(docs).orderBy("meeting_id", "idx").collect()]
    assert got == [(1, 0, "1-0", "1", "1 One", None), (1, 1, "1-1", "2", "2 Two", None), (1, 2, "1-2", None, "Two A", None), (1, 3, "9", "9", "9 Deep & down", "x" * 300), (1, 4, "1-4", "7", "7", None)]


def test_a_level_of_a_tree_is_parsed_once(spark):
    """Nodes that are no objects don't take their neighbours with them; no level reads JSON that was read with the one above."""
    trees_of = {1: '["x", {"name": "a"}, null, 3, [{"name": "in a list"}]]', 2: '[{"name": "b", "itemNumber": 1, "childItems": [{"name": "c"}, 7]}, "y"]', 3: '{"name": "no list"}', 4: ' \n[{"itemNumber": "9", "childItems": "[{\\"name\\": \\"d\\"}]", "children": {"name": "e"}}]'}
    flat = trees.flatten_items(spark.createDataFrame(list(trees_of.items()), "meeting_id long, tree string"))
    assert [(r.meeting_id, r.idx, r.title) for r in flat.orderBy("meeting_id", "idx").collect()] == [(1, 0, "a"), (2, 0, "c"), (4, 0, "d")]
    assert "get_json_object" not in flat._jdf.queryExecution().analyzed().toString()


def test_tables_of_sloppy_pages(spark):
    html = """<table ID=upcoming><tr class="odd"><td>A <b>b</b>
      c<td>June 1, 2020<td><a href="x?event_id=5&amp;y">l</a><tr class=even><td>no date<td>soon<td><a href="?event_id=6">l</a></table>
      <!-- <tr class="odd"><td>hidden --> <p>text</p> <TABLE><TR CLASS='even'><TD>D</TD><TD>12/31/99</TD><TD><A HREF='/help'>?</A><A HREF='?clip_id=7'>v</A></TD></TR>
      <tr class="header"><th>Name<th>Date</tr><tr class="even"></tr><tr class="odd"><td>last<td>01/02/03<td><a href=?clip_id=8>v"""
    pages = spark.createDataFrame([(html,), ("",), (None,), ("<tr class=odd><td>no table",)], "html string")
    got = [(r.source, r.external_id, r.title, str(r.meeting_date)) for r in listings.listed_meetings(pages).collect()]
    assert got == [("upcoming", "event-5", "A b c", "2020-06-01"), ("archive", "7", "D", "1999-12-31"), ("archive", "8", "last", "2003-01-02")]


def test_index_points(spark):
    html = '<div class="index-point" time="12.5" data-id="a">One</div><div class=index-point>no time</div><div class="other" time="1">x</div><div time=30 class="index-point">Two &amp; <b>b</b></div>'
    got = [tuple(r) for r in listings.index_points(spark.createDataFrame([(3, html), (4, "")], "clip long, html string")).collect()]
    assert got == [(3, "a", "1", "One", 12.5), (3, "3-2", "3", "Two & b", 30.0)]


def test_agenda_markers(spark):
    text = "head\nITEM 1. Pave\nthe road (Recommended by staff) (Submitted by\n the Mayor)\nAgenda – May 19, 2026 12\nmore CONSENT(ph) ITEM 2. Deed consent item 3. End"
    got = [tuple(r) for r in listings.agenda_entries(spark.createDataFrame([(1, text), (2, "no marker"), (3, None)], "meeting_id long, text string")).collect()]
    assert got == [
        (1, 0, "1", "Pave the road", "Pave the road (Recommended by staff) (Submitted by the Mayor) more", "the Mayor", False),
        (1, 1, "2", "Deed", "Deed", None, True),
        (1, 2, "3", "End", "End", None, True),
    ]


def test_an_adapter_reads_only_partitions_that_may_match(spark, tmp_path):
    path = tmp_path / "pages"
    path.mkdir()
    pq.write_table(pa.table({"page_id": pa.array(range(100)), "url": [f"u{i}" for i in range(100)]}), str(path / "a.parquet"), row_group_size=10)
    adapter = adapters.ParquetPages({"path": str(path)})
    groups = lambda *filters: [g for _, g in adapter.partitions(list(filters))]
    assert len(groups()) == 10 and groups(("page_id", "=", 35)) == [3] and groups(("page_id", ">", 79), ("page_id", "<", 95)) == [8, 9]
    assert groups(("page_id", "in", (5, 95))) == [0, 9] and len(groups(("url", "=", "u1"))) == 10 and groups(("page_id", "<=", -1)) == []
    load = lambda *where: adapters.adapted(spark, "quorumlake.sources.adapters:ParquetPages", where, path=str(path))
    found, whole = load(("page_id", ">=", 42), ("page_id", "<", 45)), load()
    assert sorted(r.page_id for r in found.filter("url <> 'u43'").collect()) == [42, 44]
    assert found.rdd.getNumPartitions() == 1 and whole.rdd.getNumPartitions() == 10
    assert whole.filter("page_id < 3").count() == 3 and whole.count() == 100
    assert load(("page_id", ">", 1000)).count() == 0 and load(("url", "in", ["u1", "u2"])).count() == 2


def listed(spark, *rows):
    schema = "page_id long, outlet string, url string, kind string, headline string, excerpt string, article_date date, subject_type string, subject_id long, subject_slug string"
    return spark.createDataFrame([(i, o, u, "note", h, "e", datetime.date(2020, 1, 1), *s) for i, o, u, h, s in rows], schema)


def test_a_second_import_adds_nothing(spark):
    first = listed(spark, (1, "o", "u", "first", ("badge", None, "x")), (2, "o", "u", "again", ("meeting", 5, None)), (3, "p", "u", "other", ("badge", None, "x")))
    entries, links = P.import_articles(None, None, first)
    assert sorted((r.outlet, r.headline, r.status) for r in entries.collect()) == [("o", "first", "draft"), ("p", "other", "draft")] and links.count() == 3
    once = P.import_articles(entries, links, first)
    assert sorted(once[0].collect()) == sorted(entries.collect()) and sorted(once[1].collect(), key=repr) == sorted(links.collect(), key=repr)
    more = P.import_articles(entries, links, listed(spark, (9, "o", "u", "changed", ("meeting", 6, None)), (10, "q", "u", "new", ("badge", None, "x"))))
    assert sorted((r.outlet, r.headline) for r in more[0].collect()) == [("o", "first"), ("p", "other"), ("q", "new")] and more[1].count() == 5


def test_publication_keeps_its_first_date_and_byline(spark):
    entries, _ = P.import_articles(None, None, listed(spark, *[(i, "o", u, "h", ("badge", None, "x")) for i, u in enumerate("abc")]))

    def act(frame, *rows):
        return P.set_status(frame, spark.createDataFrame([("o", u, s, datetime.date(2021, 1, d), b) for u, s, d, b in rows], "outlet string, url string, to_status string, on date, by string"))

    done = act(entries, ("a", "published", 1, "ann"), ("b", "nonsense", 1, "ann"), ("z", "published", 1, "ann"))
    done = act(done, ("a", "rejected", 2, "bob"), ("c", "proposed", 2, "bob"))
    done = act(done, ("a", "published", 3, "bob"))
    got = {r.url: (r.status, r.published_on and r.published_on.day, r.byline) for r in done.collect()}
    assert got == {"a": ("published", 1, "ann"), "b": ("draft", None, None), "c": ("proposed", None, None)}
