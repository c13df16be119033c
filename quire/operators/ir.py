"""Documents as arrays of typed blocks: load, check, render, compare forms, canonical diagrams.

SRC-24, STR-29, STR-65, STR-67, STR-68, ARR-28..30, ARR-33, SUP-74, SUP-75, SUP-83, SUP-84, SUP-86,
SUP-87, SUP-90, PRJ-23, DIFF-05, SET-08, AGG-37.

A block is one struct with the fields of all kinds; those that its kind lacks are null. All
operators are column expressions. A null or unreadable document has the error ``unreadable``; a
document without blocks is valid and renders to nothing; null texts and lists count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Kinds of blocks, of groups, and styles and directions of edges.
KINDS = ("heading", "paragraph", "list", "formula", "table", "code", "quote", "image", "diagram", "flow")
GROUP_KINDS = ("layer", "lane", "cluster")
STYLES = ("solid", "dashed")
_LEAF = "struct<text:string,items:array<struct<text:string>>>"
#: Lists nest up to four deep, which is what a page holds.
ITEMS = f"array<struct<text:string,items:array<struct<text:string,items:array<{_LEAF}>>>>>"
NODES, EDGES = "array<struct<id:string,label:string,note:string>>", "array<struct<`from`:string,`to`:string,label:string,style:string>>"
GROUPS = "array<struct<id:string,label:string,kind:string,nodes:array<string>>>"
BLOCK = (
    f"struct<type:string,level:int,text:string,ordered:boolean,items:{ITEMS},latex:string,inline:boolean,language:string,content:string,"
    f"headers:array<string>,rows:array<array<string>>,caption:string,src:string,alt:string,nodes:{NODES},edges:{EDGES},groups:{GROUPS},orientation:string,source:string>"
)
DOCUMENT = f"struct<document_type:string,version:int,blocks:array<{BLOCK}>>"


def _some(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _strings(c: Column) -> Column:
    return _some(c, "array<string>")


def load(c: str | Column) -> Column:
    """SRC-24: JSON as a document, null where it is none."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, DOCUMENT, {"mode": "PERMISSIVE"})


def group_errors(block: Column) -> Column:
    """ARR-33: whether groups repeat an id or name unknown nodes."""
    ids = F.transform(_some(block["nodes"], NODES), lambda n: n["id"])
    groups = _some(block["groups"], GROUPS)
    names = F.transform(groups, lambda g: g["id"])
    return (F.size(F.array_distinct(names)) < F.size(names)) | F.exists(groups, lambda g: F.size(F.array_except(_strings(g["nodes"]), ids)) > 0)


def errors(raw: str | Column) -> Column:
    """SRC-24: the first broken rule of a document's JSON, null where it is valid.

    ``unreadable``, ``extra_key`` (a top-level key that isn't known), ``unknown_block``,
    ``bad_level``, ``missing_field`` or ``bad_group``.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    doc = load(raw)
    blocks = _some(doc["blocks"], f"array<{BLOCK}>")
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    needs = {"heading": "text", "paragraph": "text", "formula": "latex", "code": "content", "quote": "text", "image": "src"}
    lacking = lambda b: F.coalesce(*(F.when((b["type"] == k) & b[f].isNull(), True) for k, f in needs.items()), F.lit(False))
    drawn = lambda b: b["type"].isin("diagram", "flow")
    return (
        F.when(F.json_object_keys(raw).isNull() | doc.isNull(), "unreadable")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, ("document_type", "version", "blocks"))))) > 0, "extra_key")
        .when(F.exists(blocks, lambda b: b.isNull() | ~F.coalesce(b["type"].isin(*KINDS), F.lit(False))), "unknown_block")
        .when(F.exists(blocks, lambda b: (b["type"] == "heading") & ~F.coalesce(b["level"].between(1, 6), F.lit(False))), "bad_level")
        .when(F.exists(blocks, lacking), "missing_field")
        .when(F.exists(blocks, lambda b: drawn(b) & group_errors(b)), "bad_group")
    )


def nonempty(doc: Column) -> Column:
    """PRJ-23: whether a document has a block."""
    return F.coalesce(F.size(doc["blocks"]) > 0, F.lit(False))


def _cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(T.text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), r"([`*_{}\[\]<>#])", r"\\$1")


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _table(b: Column) -> Column:
    headers = F.transform(_strings(b["headers"]), _cell)
    rule = F.array_repeat(F.lit("---"), F.greatest(F.size(headers), F.lit(1)))
    rows = F.transform(_some(b["rows"], "array<array<string>>"), lambda r: _row(F.transform(_strings(r), _cell)))
    lines = F.concat(F.array(_row(headers), _row(rule)), rows)
    note = F.when(T.text(b["caption"]) != "", F.concat(F.lit("\n\n*"), T.escape_markdown(b["caption"]), F.lit("*"))).otherwise("")
    return F.concat(F.array_join(lines, "\n"), note)


def _code(b: Column) -> Column:
    """A fence longer than any run of backticks inside."""
    content = T.text(b["content"])
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(content, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, T.text(b["language"]), F.lit("\n"), content, F.lit("\n"), fence)


def _list(b: Column) -> Column:
    """Items by depth; a blank line stands before a nested list."""
    marker = F.when(F.coalesce(b["ordered"], F.lit(False)), "1. ").otherwise("- ")

    def lines(items: Column, depth: int) -> Column:
        def one(x: Column) -> Column:
            head = F.concat(F.lit("  " * depth), marker, T.escape_markdown(T.text(x["text"])))
            if depth == 3:
                return F.array(head)
            inner = F.coalesce(x["items"], F.array().cast(_ITEM_TYPES[depth]))
            return F.when(F.size(inner) > 0, F.concat(F.array(head, F.lit("")), lines(inner, depth + 1))).otherwise(F.array(head))

        return F.flatten(F.transform(items, one))

    return F.array_join(lines(_some(b["items"], ITEMS), 0), "\n")


_ITEM_TYPES = {
    0: f"array<struct<text:string,items:array<{_LEAF}>>>", 1: f"array<{_LEAF}>", 2: "array<struct<text:string>>",
}


def semantics_comment(b: Column) -> Column:
    """What a picture of a diagram says beyond its nodes, as an invisible comment; null where nothing."""
    groups = F.array_sort(F.transform(F.filter(_some(b["groups"], GROUPS), lambda g: T.text(g["id"]) != ""), lambda g: F.struct(
        g["id"].alias("id"), F.coalesce(F.when(g["kind"] != "", g["kind"]), F.lit("cluster")).alias("kind"), T.text(g["label"]).alias("label"), F.array_sort(F.filter(_strings(g["nodes"]), lambda x: T.text(x) != "")).alias("nodes"))))
    notes = F.map_from_entries(F.array_sort(F.transform(F.filter(_some(b["nodes"], NODES), lambda n: (T.text(n["id"]) != "") & (T.text(n["note"]) != "")), lambda n: F.struct(n["id"], n["note"]))))
    dashed = F.array_sort(F.transform(F.filter(_some(b["edges"], EDGES), lambda e: (e["style"] == "dashed") & (T.text(e["from"]) != "") & (T.text(e["to"]) != "")), lambda e: F.array(e["from"], e["to"])))
    payload = F.to_json(F.struct(dashed.alias("dashed_edges"), groups.alias("groups"), notes.alias("notes")))
    safe = F.replace(F.replace(payload, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    return F.when((F.size(groups) > 0) | (F.size(notes) > 0) | (F.size(dashed) > 0), F.concat(F.lit("<!-- diagram-semantics: "), safe, F.lit(" -->")))


def render_block(b: Column, index: Column, doc_id: Column) -> Column:
    """STR-65: one block as Markdown; diagrams name the picture that an attachment writer makes."""
    esc = lambda c: T.escape_markdown(T.text(c))
    picture = F.concat(F.lit("!["), esc(b["caption"]), F.lit("](attachments/"), doc_id, F.lit("-"), index.cast("string"), F.lit(".png)"))
    kinds = {
        "heading": F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(1))), F.lit(" "), esc(b["text"])), "paragraph": esc(b["text"]), "list": _list(b),
        "formula": F.when(F.coalesce(b["inline"], F.lit(False)), F.concat(F.lit("$"), T.text(b["latex"]), F.lit("$"))).otherwise(F.concat(F.lit("$$\n"), T.text(b["latex"]), F.lit("\n$$"))),
        "table": _table(b), "code": _code(b), "quote": F.concat(F.lit("> "), F.replace(esc(b["text"]), F.lit("\n"), F.lit("\n> "))),
        "image": F.concat(F.lit("!["), esc(b["alt"]), F.lit("]("), T.text(b["src"]), F.lit(")")),
    }
    out = F.concat_ws("\n\n", picture, semantics_comment(b))
    for k, v in kinds.items():
        out = F.when(b["type"] == k, v).otherwise(out)
    return out


def render(doc: Column, doc_id: Column) -> Column:
    """STR-65: a valid document as Markdown; nothing for no blocks."""
    parts = F.transform(_some(doc["blocks"], f"array<{BLOCK}>"), lambda b, i: render_block(b, i, doc_id))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))).otherwise("")


def structure_text(b: Column) -> Column:
    """SUP-87: direction, caption, nodes with ids, edges; where the picture lies doesn't count."""
    nodes = F.transform(_some(b["nodes"], NODES), lambda n: F.concat_ws(":", T.text(n["id"]), T.text(n["label"])))
    edges = F.transform(_some(b["edges"], EDGES), lambda e: F.concat(T.text(e["from"]), F.lit("->"), T.text(e["to"]), F.when(T.text(e["label"]) != "", F.concat(F.lit(":"), e["label"])).otherwise("")))
    return F.array_join(F.concat(F.filter(F.array(T.text(b["orientation"]), T.text(b["caption"])), lambda x: x != ""), nodes, edges), " | ")


def compared_text(b: Column) -> Column:
    """SUP-86: a diagram's labels and edges between labels, without ids, so that two readings can be compared."""
    nodes = _some(b["nodes"], NODES)
    names = F.map_from_entries(F.transform(nodes, lambda n: F.struct(n["id"], T.text(n["label"]))))
    at = lambda x: F.coalesce(F.try_element_at(names, x), T.text(x))
    edges = F.transform(_some(b["edges"], EDGES), lambda e: F.concat_ws("->", at(e["from"]), at(e["to"])))
    return F.array_join(F.filter(F.concat(F.array(T.text(b["caption"])), F.transform(nodes, lambda n: T.text(n["label"])), edges), lambda x: x != ""), " | ")


def block_text(b: Column) -> Column:
    """STR-29: the text of a block of any kind; cells and items are joined."""
    items = F.flatten(F.transform(_some(b["items"], ITEMS), lambda x: F.concat(F.array(T.text(x["text"])), F.transform(F.coalesce(x["items"], F.array().cast(_ITEM_TYPES[0])), lambda y: T.text(y["text"])))))
    cells = F.concat(F.filter(F.array(T.text(b["caption"])), lambda x: x != ""), _strings(b["headers"]), F.flatten(_some(b["rows"], "array<array<string>>")))
    out = structure_text(b)
    for k, v in {"list": F.array_join(items, " | "), "table": F.array_join(cells, " | "), "formula": T.text(b["latex"]), "code": T.text(b["content"]), "image": T.text(b["alt"])}.items():
        out = F.when(b["type"] == k, v).otherwise(out)
    return F.when(b["type"].isin("heading", "paragraph", "quote"), T.text(b["text"])).otherwise(out)


def canonical_groups(groups: Column, ids: Column) -> Column:
    """SUP-83: groups by id, their known members sorted and once, ``cluster`` where no kind is given."""
    return F.array_sort(F.transform(_some(groups, GROUPS), lambda g: F.struct(
        T.text(g["id"]).alias("id"), T.text(g["label"]).alias("label"), F.coalesce(F.when(g["kind"] != "", g["kind"]), F.lit("cluster")).alias("kind"), F.array_sort(F.array_distinct(F.array_intersect(_strings(g["nodes"]), ids))).alias("nodes"))))


def canonical_edges(edges: Column, ids: Column) -> Column:
    """ARR-29, SUP-84: edges between known nodes in order; an unknown style is solid, repeats stay."""
    known = F.filter(_some(edges, EDGES), lambda e: F.array_contains(ids, T.text(e["from"])) & F.array_contains(ids, T.text(e["to"])))
    return F.array_sort(F.transform(known, lambda e: F.struct(
        e["from"].alias("from"), e["to"].alias("to"), T.text(e["label"]).alias("label"), F.when(e["style"].isin(*STYLES), e["style"]).otherwise("solid").alias("style"))))


def diagram_verdict(raw: str | Column) -> Column:
    """ARR-28: ``ok``, ``no_flow`` (the reply names an error) or ``malformed`` of a diagram's JSON."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    d = F.from_json(raw, f"struct<error:string,nodes:{NODES},edges:{EDGES},groups:{GROUPS}>")
    ids = F.transform(_some(d["nodes"], NODES), lambda n: n["id"])
    edges, groups = _some(d["edges"], EDGES), _some(d["groups"], GROUPS)
    bad_edge = F.exists(edges, lambda e: ~F.array_contains(ids, T.text(e["from"])) | ~F.array_contains(ids, T.text(e["to"])) | (e["from"] == e["to"]) | ~F.coalesce(e["style"], F.lit("solid")).isin(*STYLES))
    bad_group = F.exists(groups, lambda g: ~F.coalesce(g["kind"], F.lit("cluster")).isin(*GROUP_KINDS)) | group_errors(d)
    good = F.json_object_keys(raw).isNotNull() & d["nodes"].isNotNull() & d["edges"].isNotNull() & (F.size(ids) > 0)
    clean = ~F.exists(ids, lambda x: x.isNull()) & (F.size(F.array_distinct(ids)) == F.size(ids)) & ~bad_edge & ~bad_group
    return F.when(F.length(d["error"]) > 0, "no_flow").when(good & clean, "ok").otherwise("malformed")


def edge_labels(nodes: Column, edges: Column) -> Column:
    """SET-08: distinct pairs of folded labels that edges join."""
    names = F.map_from_entries(F.transform(_some(nodes, NODES), lambda n: F.struct(n["id"], T.label_fold(T.text(n["label"])))))
    return F.array_distinct(F.transform(_some(edges, EDGES), lambda e: F.concat_ws("->", F.try_element_at(names, e["from"]), F.try_element_at(names, e["to"]))))


def diagram_scores(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """AGG-37: edge hits, precision and recall, label hits of a read diagram against the true one."""
    p, t = edge_labels(F.col(f"{pred}.nodes"), F.col(f"{pred}.edges")), edge_labels(F.col(f"{truth}.nodes"), F.col(f"{truth}.edges"))
    hits = F.size(F.array_intersect(p, t))
    labels = lambda c: F.array_distinct(F.transform(_some(F.col(f"{c}.nodes"), NODES), lambda n: T.label_fold(T.text(n["label"]))))
    return rows.select(
        "*", hits.alias("edge_hits"), F.round(F.try_divide(hits, F.size(p)), 4).alias("precision"), F.round(F.try_divide(hits, F.size(t)), 4).alias("recall"),
        F.round(F.try_divide(F.size(F.array_intersect(labels(pred), labels(truth))), F.size(labels(truth))), 4).alias("label_hits"), (F.size(f"{pred}.nodes") == F.size(f"{truth}.nodes")).alias("same_nodes"),
    )


def replace_graph(blocks: Column, flow: Column) -> Column:
    """ARR-30: blocks without flows and diagrams, and one flow behind them."""
    return F.concat(F.filter(_some(blocks, f"array<{BLOCK}>"), lambda b: ~b["type"].isin("diagram", "flow")), F.array(flow))


def with_source(blocks: Column, source: Column) -> tuple[Column, Column]:
    """SUP-90: diagrams without nodes get the picture they came from; and their indices."""
    empty = lambda b: b["type"].isin("diagram", "flow") & (F.size(_some(b["nodes"], NODES)) == 0)
    new = F.transform(blocks, lambda b: F.when(empty(b), b.withField("source", source)).otherwise(b))
    return new, F.filter(F.transform(blocks, lambda b, i: F.when(empty(b), i)), lambda i: i.isNotNull())


def one_sided(doc: Column, side: str) -> Column:
    """DIFF-05: all blocks of a document as found on one side only."""
    return F.transform(_some(doc["blocks"], f"array<{BLOCK}>"), lambda b, i: F.struct(F.lit("one_side").alias("status"), F.lit(side).alias("side"), i.alias("index"), b["type"].alias("block_type"), block_text(b).alias("text")))


def note(docs: DataFrame, exported_at: str) -> DataFrame:
    """STR-67: (path, content) of one note a document: front matter, then the text."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    labels = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    title = F.coalesce(F.when(T.stripped(T.text("title")) != "", T.stripped("title")), F.col("document_id"))
    head = F.concat_ws("\n", F.lit("---"), line("title", title), line("id", F.col("document_id")), line("topics", labels(F.col("topics"))), line("tags", labels(F.col("tags"))), line("exported", F.lit(exported_at)), F.lit("---"))
    return docs.select(F.concat(F.lit("notes/"), T.file_id("document_id"), F.lit(".md")).alias("path"), F.concat(head, F.lit("\n\n"), T.text("current_markdown"), F.lit("\n")).alias("content"))


def moc(docs: DataFrame) -> DataFrame:
    """STR-68: (path, content) of one list of notes a topic, by document id.

    Members are folded in partial aggregates, a list holds a line a member.
    """
    row = docs.select(F.explode("topics").alias("topic"), "document_id", F.concat(F.lit("- [["), T.file_id("document_id"), F.lit("]]")).alias("line"))
    per = row.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("document_id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return per.select(F.concat(F.lit("topics/"), T.vault_name("topic"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "topic", F.lit("\n\n"), "lines", F.lit("\n")).alias("content"))


def vault_files(docs: DataFrame, exported_at: str) -> DataFrame:
    """SUP-74, SUP-75: (kind, path, content, fingerprint) of all files of an export; the manifest is these rows without content."""
    files = note(docs, exported_at).withColumn("kind", F.lit("note")).unionByName(moc(docs).withColumn("kind", F.lit("topic")))
    return files.select("kind", "path", "content", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))
