"""Nested agendas flattened by recursion: documents of unknown depth become items in reading order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.model import Civic
from quorumlake.plans.registry import query

SHOWN = 300
_NAMES, _NUMBERS, _CHILDREN = ("agendaObjectItemName", "name", "itemName"), ("agendaObjectItemNumber", "itemNumber", "outlineNumber"), ("childItems", "children")
_KEYS = [*_NAMES, *_NUMBERS, *_CHILDREN, "description", "isSection", "id", "itemId"]


def _listed(nodes: str) -> str:
    """SQL of the fields of each node of a JSON array, from one parse; where that fails, as when a node is no object, each node is
    parsed on its own."""
    node = ", ".join(f"{k} string" for k in _KEYS)
    whole = f"CASE WHEN {nodes} RLIKE '^[ \\\\t\\\\r\\\\n]*[\\\\[]' THEN from_json({nodes}, 'array<struct<{node}>>') END"
    return f"coalesce({whole}, transform(from_json({nodes}, 'array<string>'), node -> from_json(node, '{node}')))"


def flatten_items(documents: DataFrame) -> DataFrame:
    """meeting_id, idx, external_id, number, title, description of documents(meeting_id, tree), tree being a JSON array of nodes.

    A node's name, number and children stand under the first of several keys that holds one. Section headers are dropped
    (isSection, or children and no agendaObjectItemNumber), as are nodes without number and name; their children stay. idx
    counts the items of a document in reading order, from 0; without an id of its own an item takes meeting and idx. Tags and
    entities are taken out, descriptions cut to SHOWN characters. Each level is one step of a recursive query, so the depth needs no
    bound; a document that is no JSON array has no items.
    """
    spark = documents.sparkSession
    view = f"trees_{uuid.uuid4().hex}"
    documents.select("meeting_id", "tree").createOrReplaceTempView(view)
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(limit, "-1")
    nodes = spark.sql(f"""
        WITH RECURSIVE nodes(meeting_id, place, f) AS (
            SELECT meeting_id, array(pos), node FROM {view} LATERAL VIEW posexplode({_listed("tree")}) t AS pos, node
            UNION ALL
            SELECT meeting_id, concat(place, array(pos)), child FROM nodes LATERAL VIEW posexplode({_listed("coalesce(f.childItems, f.children)")}) t AS pos, child
        ) SELECT * FROM nodes""")
    first = lambda keys: F.coalesce(*[F.nullif(f"f.{k}", F.lit("")) for k in keys], F.lit(""))
    clean = lambda x: F.trim(unescaped(F.regexp_replace(x, "<[^>]+>", "")))
    kids = F.coalesce(*[F.nullif(f"f.{k}", F.lit("[]")) for k in _CHILDREN]).isNotNull()
    header = (F.col("f.isSection") == "true") | (F.nullif("f.agendaObjectItemNumber", F.lit("")).isNull() & kids)
    number, text = first(_NUMBERS), clean(F.coalesce("f.description", F.lit("")))
    rows = nodes.select(
        "meeting_id", "place", F.nullif(number, F.lit("")).alias("number"), F.trim(F.concat_ws(" ", number, clean(first(_NAMES)))).alias("title"),
        F.nullif(F.substring(text, 1, SHOWN), F.lit("")).alias("description"), F.coalesce("f.id", "f.itemId").alias("own"), F.coalesce(header, F.lit(False)).alias("header"),
    ).filter("not header and title <> ''")
    # a document's items in reading order, as one row: its size is the document's
    listed = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("place", "number", "title", "description", "own"))).alias("items"))
    flat = listed.select("meeting_id", F.posexplode("items").alias("idx", "i"))
    external = F.coalesce("i.own", F.concat_ws("-", F.col("meeting_id").cast("string"), F.col("idx").cast("string")))
    return flat.select("meeting_id", F.col("idx").cast("long").alias("idx"), external.alias("external_id"), "i.number", "i.title", "i.description")


def unescaped(text):
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def agenda_trees(c: Civic) -> DataFrame:
    """meeting_id and tree: a section of the items that hang one under the other, as deep as there are items, and one of consent
    items side by side."""
    numbered = F.concat(F.lit('"agendaObjectItemNumber":"'), F.col("item_number"), F.lit('",'))
    own = F.when(F.col("priority") == "high", F.concat(F.lit('"id":'), F.col("item_id").cast("string"), F.lit(","))).otherwise("")
    text = F.concat(own, numbered, F.lit('"name":"<b>'), F.col("topic"), F.lit('</b> &amp; '), F.col("counterparty"), F.lit('","description":"'), F.coalesce("description", F.lit("")), F.lit('"'))
    items = c.item.select("meeting_id", "item_id", "is_consent", text.alias("t"))
    parts = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("item_id", "t")))), lambda x: x["t"])
    held = items.groupBy("meeting_id").agg(parts(~F.col("is_consent")).alias("deep"), parts(F.col("is_consent")).alias("flat"))
    deep = F.concat(F.array_join(F.transform("deep", lambda t: F.concat(F.lit("{"), t, F.lit(',"childItems":['))), ""), F.repeat(F.lit("]}"), F.size("deep")))
    flat = F.array_join(F.transform("flat", lambda t: F.concat(F.lit("{"), t, F.lit("}"))), ",")
    tree = F.concat(F.lit('[{"name":"Business","isSection":true,"children":['), deep, F.lit(']},{"itemName":"Consent","childItems":['), flat, F.lit(",{}]}]"))
    return held.select("meeting_id", F.regexp_replace(tree, r"\[,", "[").alias("tree"))


@query("src_json_tree_flatten", """SELECT meeting_id, idx, CASE WHEN priority = 'high' THEN CAST(item_id AS VARCHAR) ELSE meeting_id || '-' || idx END AS external_id, item_number AS number,
    item_number || ' ' || topic || ' & ' || counterparty AS title, nullif(substr(coalesce(description, ''), 1, 300), '') AS description
    FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY is_consent, item_id) - 1 AS idx FROM item)""")
def src_json_tree_flatten(c: Civic) -> DataFrame:
    return flatten_items(agenda_trees(c))
