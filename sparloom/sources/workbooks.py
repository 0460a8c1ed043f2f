"""XLSX workbooks, read and written with zip and XML only. Files come and go through Spark's file sources, so
any store that Spark reads will do; a workbook is one row and must fit in memory."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.functions.text import stripped

# XML name spaces and content types of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


#: Rows of a sheet that are Python objects at once.
AT_ONCE = 5_000


def column_index(reference: str) -> int:
    """Zero-based column of a cell reference."""
    n = 0
    for letter in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = 26 * n + ord(letter) - 64
    return n - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def parse(content: bytes) -> list[list[str]]:
    """Cells of the first sheet as text; rows are padded to their last cell."""
    return list(parsed_rows(content))


def parsed_rows(content: bytes) -> Iterator[list[str]]:
    """The rows of ``parse`` one after the other: the sheet is read as a stream, and a row's nodes are dropped with it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        shared = [text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        sheet = "xl/worksheets/sheet1.xml"
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"), None)
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            target = targets.get(first.get(f"{REL}id")) if first is not None else None
            if target:
                sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        opened: list = []
        for event, row in ElementTree.iterparse(z.open(sheet), ("start", "end")):
            if event == "start":
                opened.append(row)
                continue
            opened.pop()
            if row.tag != f"{MAIN}row":
                continue
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{MAIN}c")):
                at = column_index(c.get("r")) if c.get("r") else k
                value = c.find(f"{MAIN}v")
                raw = value.text or "" if value is not None else ""
                cells[at] = text(c) if c.get("t") == "inlineStr" else shared[int(raw)] if c.get("t") == "s" and raw else raw
            yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
            if opened:
                opened[-1].remove(row)


def build(rows: Iterable[list[str]], choices: dict[int, list[str]] | None = None) -> bytes:
    """A workbook of one sheet, written row by row, with a bold first row; ``choices``: allowed values by column, as drop-down lists."""
    cell = lambda r, c, v: f'<c r="{column_letters(c)}{r}" t="inlineStr"{" s=\"1\"" if r == 1 else ""}><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    body = (f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    ns = MAIN[1:-1]
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{REL[1:-1]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{ns}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), head + data)
        n, info = 0, zipfile.ZipInfo("xl/worksheets/sheet1.xml", (2000, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_DEFLATED
        with z.open(info, "w") as f:
            f.write(f'{head}<worksheet xmlns="{ns}"><sheetData>'.encode())
            for n, line in enumerate(body, 1):  # noqa: B007
                f.write(line.encode())
            lists = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{column_letters(c)}2:{column_letters(c)}{max(2, n)}"><formula1>"{escape(",".join(v))}"</formula1></dataValidation>' for c, v in sorted((choices or {}).items()))
            f.write(("</sheetData>" + (f'<dataValidations count="{len(choices)}">{lists}</dataValidations>' if choices else "") + "</worksheet>").encode())
    return out.getvalue()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            first = 1
            for rows in itertools.batched(parsed_rows(content.as_py()), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["path", "source_row", "cells"])
                first += len(rows)


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """(path, source_row from 1, cells) of every workbook below a folder; lock files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(root)
    kept = files.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")
    return kept.mapInArrow(_rows, "path string, source_row int, cells array<string>")


def records(cells: DataFrame) -> DataFrame:
    """(path, source_row, header, record: map of column to trimmed cell) of rows with any filled cell: short
    rows are padded, cells beyond the header dropped."""
    head = cells.filter("source_row = 1").select("path", F.transform("cells", stripped).alias("header"))
    pairs = F.transform("header", lambda h, i: F.struct(h.alias("key"), stripped(F.coalesce(F.get("cells", i), F.lit(""))).alias("value")))
    rows = cells.filter("source_row > 1").join(head, "path").withColumn("pairs", pairs).filter(F.exists("pairs", lambda p: p["value"] != ""))
    filled = F.filter("pairs", lambda p: p["key"] != "")
    first = F.filter(filled, lambda p, i: F.array_position(F.transform(filled, lambda q: q["key"]), p["key"]) == i + 1)
    return rows.select("path", "source_row", "header", F.map_from_entries(first).alias("record"))


def schema_guess(header: Column) -> Column:
    """Which annotation table a header belongs to."""
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), header)) == 0
    return (
        F.when(has("finding_id", "view") & (has("feature_key") | has("element_name")), "human_visual_findings")
        .when(has("rule_id", "rule_validity", "atomic_value"), "atomic_rule_audit")
        .when(has("human_finding_id", "atomic_rule_id", "candidate_match_type"), "human_to_atomic_rule_mapping")
        .when(view_schema(header) == "v3_visible_status", "v3_rule_level")
        .otherwise("unknown")
    )


def view_schema(header: Column) -> Column:
    """Whether an annotation sheet has visibility and status by view, or the older booleans; else null."""
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), header)) == 0
    return F.when(has("front_visible", "front_status", "side_visible", "side_status", "back_visible", "back_status"), "v3_visible_status").when(has("front", "side", "back", "result"), "legacy_front_side_back_bool")


def as_table(rows: DataFrame, columns) -> DataFrame:
    """Columns out of the record maps; what a sheet lacks is blank."""
    return rows.select("path", "source_row", "header", *[F.coalesce(F.try_element_at("record", F.lit(c)), F.lit("")).alias(c) for c in columns])


def to_workbooks(df: DataFrame, keys: list[str], columns: list[str], order: list[str], choices: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, content): a workbook for each group of rows, in order. A group is one sheet, so it is as small
    as a reviewer's sheet."""
    listed = {columns.index(c): v for c, v in (choices or {}).items()}

    def sheet(key: tuple, table: pa.Table) -> pa.Table:
        parts = table.sort_by([(c, "ascending") for c in order]).select(columns).to_batches(max_chunksize=AT_ONCE)
        rows = ([str(v if v is not None else "") for v in row] for part in parts for row in zip(*[c.to_pylist() for c in part.columns], strict=True))
        content = build(itertools.chain([columns], rows), listed)
        return pa.table({**{k: pa.array([v.as_py() if hasattr(v, "as_py") else v]) for k, v in zip(keys, key, strict=True)}, "content": pa.array([content], pa.binary())})

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", content binary"
    return df.groupBy(*keys).applyInArrow(sheet, schema)


def changed_cells(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_row, place, was, now) of the cells that differ between two readings (keys, source_row, cells) of
    the same workbooks; a cell that one lacks is blank."""
    cells = lambda d, name: d.select(*keys, "source_row", F.posexplode("cells").alias("place", name))
    both = cells(before, "was").join(cells(after, "now"), [*keys, "source_row", "place"], "full_outer").fillna("", ["was", "now"])
    return both.filter("was <> now")


def assert_unchanged(before: DataFrame, after: DataFrame, keys: list[str]) -> None:
    """An error that names a cell if a rewrite of workbooks (their lists of choices, say) changed any."""
    if found := changed_cells(before, after, keys).limit(1).collect():
        raise ValueError(f"a cell was changed: {found[0].asDict()}")


def merge_edits(written: DataFrame, edited: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str], order: str = "source_row") -> DataFrame:
    """(keys, columns, place, conflicts): a three-way merge of sheets, cell by cell. ``written`` is what a workbook was
    made from, ``edited`` what it holds now, ``fresh`` what it would be made from today; ``order`` numbers the rows of each.

    A cell that one side left alone takes what the other side put there; one that both changed, and not alike, keeps the
    edit, and its column is named in ``conflicts``. A row that one side dropped is gone if the other left it alone;
    otherwise it stays, with the conflict ``row_removed`` (dropped from fresh, edited by hand) or ``row_restored`` (deleted
    by hand, changed in fresh). Rows that only one side added stay. A null cell is blank; of rows with one key the first
    counts. Rows stand in the order of fresh, then those that only the edited sheet has. One shuffle by key."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    side = lambda d, name: d.select(*keys, F.lit(name).alias("_side"), F.col(order).cast("long").alias("_row"), cells.alias("_cells"))
    every = side(written, "was").unionByName(side(edited, "mine")).unionByName(side(fresh, "new"))
    row = lambda name: F.when(F.col("_side") == name, F.col("_row"))
    d = every.groupBy(*keys).agg(*[F.min_by("_cells", row(n)).alias(f"_{n}") for n in ("was", "mine", "new")], F.min(row("new")).alias("_new_row"), F.min(row("mine")).alias("_mine_row"))
    was, mine, new = F.col("_was"), F.col("_mine"), F.col("_new")
    both = mine.isNotNull() & new.isNotNull()
    gone = was.isNotNull() & ((mine.isNull() & (new.isNull() | (new == was))) | (new.isNull() & (mine == was)))
    old = lambda i: F.get(was, i)  # noqa: E731  (null for a row that was not written: any two values then differ from it)
    clash = lambda i: both & (F.get(mine, i) != F.get(new, i)) & ~F.coalesce((F.get(mine, i) == old(i)) | (F.get(new, i) == old(i)), F.lit(False))
    value = lambda i: F.when(~both, F.coalesce(F.get(mine, i), F.get(new, i))).when(F.coalesce(F.get(mine, i) == old(i), F.lit(False)), F.get(new, i)).otherwise(F.get(mine, i))
    named = F.array(*[F.when(clash(F.lit(i)), F.lit(c)) for i, c in enumerate(columns)])
    of_row = F.array(F.when(was.isNotNull() & new.isNull(), F.lit("row_removed")).when(was.isNotNull() & mine.isNull(), F.lit("row_restored")))
    place = F.struct(F.col("_new_row").isNull().alias("late"), F.coalesce("_new_row", "_mine_row").alias("row"))
    return d.filter(~F.coalesce(gone, F.lit(False))).select(*keys, *[value(F.lit(i)).alias(c) for i, c in enumerate(columns)], place.alias("place"), F.array_compact(F.concat(named, of_row)).alias("conflicts"))


def _with_choices(batches: Iterator[pa.RecordBatch], choices: dict[str, list[str]], required: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for content in batch.column("content").to_pylist():
            rows = parse(content)
            header = [c.strip() for c in rows[0]] if rows else []
            if not required <= set(header):
                made.append((content, len(rows), f"columns are missing: {', '.join(sorted(required - set(header)))}"))
                continue
            out = build(rows, {header.index(c): v for c, v in choices.items() if c in header})
            kept = parse(out) == rows
            made.append((out if kept else content, len(rows), None if kept else "cells were changed"))
        content, n, problem = zip(*made, strict=True) if made else ((), (), ())
        extra = [batch.column(c) for c in batch.schema.names if c != "content"]
        yield pa.RecordBatch.from_arrays([*extra, pa.array(content, pa.binary()), pa.array(n, pa.int32()), pa.array(problem, pa.string())], names=[*(c for c in batch.schema.names if c != "content"), "content", "n_rows", "problem"])


def with_choices(files: DataFrame, choices: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Workbooks (keys, content) with drop-down lists put on their columns anew, and (n_rows, problem). A workbook
    without the required columns, or whose cells would not read back as they were, stays as it is and has a problem."""
    keys = [c for c in files.columns if c != "content"]
    schema = ", ".join([*(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys), "content binary", "n_rows int", "problem string"])
    needed = frozenset(required)
    return files.select(*keys, "content").mapInArrow(lambda it: _with_choices(it, choices, needed), schema)


def replace_unproblematic(files: DataFrame) -> DataFrame:
    """(keys, content) of ``with_choices``; an error that names the problem if any workbook has one."""
    wrong = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean"))
    return files.filter(wrong).drop("n_rows", "problem")
