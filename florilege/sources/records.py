"""Parsers of raw responses that have been fetched already: tagged flat records, link lists, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import non_empty
from florilege.session import stage

#: Fixed value: the width of the field name in tagged flat records.
TAG_WIDTH = 12


def flat_record_fields(df: DataFrame, record: str, body: str) -> DataFrame:
    """(record, field, place, value) of tagged flat records: 12 columns of field name, a blank name continues the field.

    "///" ends a record; closing ";" of values are dropped. Lines are numbered inside their record, so a
    window over one record fills the names; a record is one text and thus bounded.
    """
    lines = df.select(record, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\r?\n")).alias("line_no", "line")).filter("line <> '' and line <> '///'")
    tag = F.nullif(F.trim(F.substring("line", 1, TAG_WIDTH)), F.lit(""))
    so_far = Window.partitionBy(record).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.select(record, "line_no", F.last(tag, ignorenulls=True).over(so_far).alias("field"), non_empty(F.regexp_replace(F.expr(f"substring(line, {TAG_WIDTH + 1})"), r";\s*$", "")).alias("value")).filter("value is not null and field is not null")
    place = F.row_number().over(Window.partitionBy(record, "field").orderBy("line_no"))
    return named.select(record, "field", place.alias("place"), "value")


def link_lines(df: DataFrame, record: str, body: str) -> DataFrame:
    """(record, source_id, target_db, target_id) of lines "source<TAB>db:target"."""
    lines = df.select(record, F.explode(F.split(F.coalesce(F.col(body), F.lit("")), "\r?\n")).alias("line")).filter(F.col("line").contains("\t"))
    target = F.split_part("line", F.lit("\t"), F.lit(2))
    return lines.select(record, F.split_part("line", F.lit("\t"), F.lit(1)).alias("source_id"), F.split_part(target, F.lit(":"), F.lit(1)).alias("target_db"), F.split_part(target, F.lit(":"), F.lit(2)).alias("target_id")).distinct()


def match_lines(df: DataFrame, query: str, body: str) -> DataFrame:
    """(query, entry_id, names) of lines "id<TAB>name; name"."""
    lines = df.select(query, F.explode(F.split(F.coalesce(F.col(body), F.lit("")), "\r?\n")).alias("line")).filter(F.col("line").contains("\t"))
    return lines.select(query, F.split_part("line", F.lit("\t"), F.lit(1)).alias("entry_id"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("names"))


def json_scalars(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, name, value) of the top-level values of a JSON object; texts that do not parse have none."""
    pairs = F.from_json(F.col(column), "map<string,string>")
    return df.select(row_id, F.explode(pairs).alias("name", "value")).filter("value is not null")


_INFORMATION = "array<struct<Name: string, ReferenceNumber: bigint, URL: string, Value: struct<Number: array<double>, Unit: string, StringWithMarkup: array<struct<String: string>>>>>"


def nested_sections(df: DataFrame, row_id: str, column: str, root: str = "$.Record.Section") -> DataFrame:
    """(row_id, path, name, reference, text, numbers, unit) of a nested section document, to any depth.

    Each level is one explode of the one before, written until a level is empty. Documents that do not
    parse have no rows; a section without a heading has an empty part in its path.
    """
    doc = df.select(row_id, F.try_parse_json(column).alias("d"))
    level = stage(doc.select(row_id, F.lit(None).cast("string").alias("path"), F.explode(F.try_variant_get("d", root, "array<variant>")).alias("s")), "sections")
    out = None
    while True:
        here = level.select(row_id, F.concat_ws(" > ", "path", F.coalesce(F.try_variant_get("s", "$.TOCHeading", "string"), F.lit(""))).alias("path"), "s")
        info = here.select(row_id, "path", F.explode(F.try_variant_get("s", "$.Information", "array<variant>")).alias("x")).select(row_id, "path", F.from_json(F.to_json("x"), _INFORMATION.removeprefix("array<").removesuffix(">")).alias("i"))
        rows = info.select(
            row_id, "path", F.col("i.Name").alias("name"), F.col("i.ReferenceNumber").alias("reference"), F.array_join(F.transform("i.Value.StringWithMarkup", lambda x: x["String"]), "; ").alias("text"),
            F.col("i.Value.Number").alias("numbers"), F.col("i.Value.Unit").alias("unit"),
        )
        out = rows if out is None else out.unionByName(rows)
        level = stage(here.select(row_id, "path", F.explode(F.try_variant_get("s", "$.Section", "array<variant>")).alias("s")), "sections")
        if level.isEmpty():
            return out


def property_table(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, cid, name, value) of {"PropertyTable": {"Properties": [{"CID": ..., ...}]}}."""
    t = F.from_json(F.col(column), "struct<PropertyTable: struct<Properties: array<map<string,string>>>>")
    rows = df.select(row_id, F.explode(t["PropertyTable"]["Properties"]).alias("m"))
    return rows.select(row_id, F.col("m")["CID"].try_cast("bigint").alias("cid"), F.explode("m").alias("name", "value")).filter("name <> 'CID' and value is not null")


def synonym_rows(df: DataFrame, column: str) -> DataFrame:
    """Distinct (cid, synonym) of {"InformationList": {"Information": [{"CID": ..., "Synonym": [...]}]}}."""
    t = F.from_json(F.col(column), "struct<InformationList: struct<Information: array<struct<CID: bigint, Synonym: array<string>>>>>")
    rows = df.select(F.explode(t["InformationList"]["Information"]).alias("i")).select(F.col("i.CID").alias("cid"), F.explode("i.Synonym").alias("s"))
    return rows.select("cid", non_empty(F.col("s")).alias("synonym")).filter("synonym is not null").distinct()


def alias_cid(c: Column) -> Column:
    """The number of a token such as "CID: 123"; null for other texts."""
    return F.regexp_extract(c, r"(?i)^\s*cid\s*[: ]\s*([0-9]+)\s*$", 1).try_cast("bigint")


_ASSAY = (
    "struct<PC_AssayContainer: array<struct<assay: struct<descr: struct<aid: struct<id: bigint>, name: string, aid_source: struct<db: struct<name: string, source_id: struct<str: string>>>, "
    "target: array<struct<name: string, descr: string, mol_id: struct<protein_accession: string, gene_id: bigint>, organism: struct<org: struct<taxname: string, common: string>>>>, results: array<struct<name: string>>>>>>>"
)


def assay_details(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Assay descriptors: row_id, aid, assay_name, source_name, source_id, targets, accessions, genes, organisms, common_names, endpoints, n_endpoints; lists joined."""
    t = df.select(row_id, F.explode(F.from_json(F.col(column), _ASSAY)["PC_AssayContainer"]).alias("c")).select(row_id, F.col("c.assay.descr").alias("x"))
    joined = lambda c, f: F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(c, f), lambda v: v.isNotNull())), "; "), F.lit(""))
    target = F.col("x.target")
    return t.select(
        row_id, F.col("x.aid.id").alias("aid"), F.col("x.name").alias("assay_name"), F.col("x.aid_source.db.name").alias("source_name"), F.col("x.aid_source.db.source_id.str").alias("source_id"),
        joined(target, lambda v: F.coalesce(v["name"], v["descr"])).alias("targets"), joined(target, lambda v: v["mol_id"]["protein_accession"]).alias("accessions"), joined(target, lambda v: v["mol_id"]["gene_id"].cast("string")).alias("genes"),
        joined(target, lambda v: v["organism"]["org"]["taxname"]).alias("organisms"), joined(target, lambda v: v["organism"]["org"]["common"]).alias("common_names"), joined(F.col("x.results"), lambda v: v["name"]).alias("endpoints"),
        F.coalesce(F.size("x.results"), F.lit(0)).alias("n_endpoints"),
    )


_TREES = "struct<Hierarchies: struct<Hierarchy: array<struct<SourceName: string, SourceID: string, Information: struct<Name: string, HNID: bigint>, Node: array<struct<NodeID: string, ParentID: array<string>, Information: struct<Name: string, HNID: bigint, Match: boolean>>>>>>>"


def classification_paths(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, source, tree, hnid, class_name, path): of each tree every matched node with its path from the root, " > " between.

    The path follows each node's first parent inside its tree, so the order of the nodes does not matter; a
    path that comes back to a node it has passed ends there.
    """
    trees = df.select(row_id, F.explode(F.from_json(F.col(column), _TREES)["Hierarchies"]["Hierarchy"]).alias("h"))
    key = lambda n: n["NodeID"]
    named = F.map_from_entries(F.transform("h.Node", lambda n: F.struct(key(n), F.struct(n["Information"]["Name"].alias("name"), F.get(n["ParentID"], 0).alias("up")))))
    rows = trees.select(row_id, F.col("h.SourceName").alias("source"), F.col("h.Information.Name").alias("tree"), named.alias("m"), F.size("h.Node").alias("n"), F.explode(F.filter("h.Node", lambda n: F.coalesce(n["Information"]["Match"], F.lit(False)))).alias("leaf"))
    start = F.struct(F.array(F.col("leaf.Information.Name")).alias("names"), F.get("leaf.ParentID", 0).alias("at"), F.array(F.col("leaf.NodeID")).alias("seen"))

    def up(state: Column, _: Column) -> Column:
        node = F.try_element_at(F.col("m"), state["at"])
        there = node.isNotNull() & ~F.array_contains(state["seen"], state["at"])
        return F.when(there, F.struct(F.concat(F.array(node["name"]), state["names"]).alias("names"), node["up"].alias("at"), F.concat(state["seen"], F.array(state["at"])).alias("seen"))).otherwise(state)

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), start, up)
    return rows.select(row_id, "source", "tree", F.col("leaf.Information.HNID").alias("hnid"), F.col("leaf.Information.Name").alias("class_name"), F.array_join(walked["names"], " > ").alias("path"))


def key_values(df: DataFrame, row_id: str, body: str) -> DataFrame:
    """(row_id, line_no, name, value) of lines "name: value", the names in lower case; other lines continue the value before them."""
    lines = df.select(row_id, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\r?\n")).alias("line_no", "line"))
    named = r"^([A-Za-z][A-Za-z_ ]{0,30}):\s*(.*)$"
    name = F.nullif(F.lower(F.regexp_extract("line", named, 1)), F.lit(""))
    so_far = Window.partitionBy(row_id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(name.isNotNull(), F.col("line_no"))
    rows = lines.select(row_id, "line_no", F.last(start, ignorenulls=True).over(so_far).alias("at"), name.alias("name"), F.when(name.isNotNull(), F.regexp_extract("line", named, 2)).otherwise(F.col("line")).alias("text")).filter("at is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return rows.groupBy(row_id, F.col("at").alias("line_no")).agg(F.max("name").alias("name"), non_empty(F.array_join(parts, " ")).alias("value")).filter("value is not null")


def column_row_table(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, row_no, name, value) of {"Table": {"Columns": {"Column": [...]}, "Row": [{"Cell": [...]}]}}."""
    t = F.from_json(F.col(column), "struct<Table: struct<Columns: struct<Column: array<string>>, Row: array<struct<Cell: array<string>>>>>")
    rows = df.select(row_id, t.alias("t")).select(row_id, F.col("t.Table.Columns.Column").alias("names"), F.posexplode("t.Table.Row").alias("row_no", "r"))
    cells = rows.select(row_id, "row_no", F.explode(F.arrays_zip("names", F.col("r.Cell").alias("cells"))).alias("c"))
    return cells.select(row_id, "row_no", F.col("c.names").alias("name"), non_empty(F.col("c.cells")).alias("value")).filter("value is not null")
