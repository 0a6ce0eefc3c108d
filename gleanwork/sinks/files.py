"""Results as files: by category, as CSV, as workbooks, and only if they changed."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions import text as X
from gleanwork.operators.summary import digest
from gleanwork.sources import storage

#: Rows of a sheet below its header; a spreadsheet cannot hold more. Further rows go to further sheets.
MOST_ROWS = 1_048_575
_MAIN = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def by_category(records: DataFrame, folder: str, category: str = "category", columns: list[str] | None = None) -> None:
    """Parquet files in one folder for each category, cells safe for spreadsheets. Written in parallel."""
    columns = columns or [c for c in records.columns if c != category]
    safe = records.select(category, *[X.cell_safe(F.col(c)).alias(c) for c in columns])
    safe.write.mode("overwrite").partitionBy(category).parquet(folder)


def write_if_changed(df: DataFrame, folder: str) -> bool:
    """Write ``df`` unless the digest beside the folder says that it is what was written last."""
    spark, note = df.sparkSession, f"{folder}.digest.json"
    row = digest(df).first()
    sign = {"rows": row[0], "digest": str(row[1])}
    before = storage.read_text(spark, note)
    if before and storage.exists(spark, folder) and json.loads(before) == sign:
        return False
    df.write.mode("overwrite").parquet(folder)
    storage.write_text(spark, note, json.dumps(sign))
    return True


def ledger_csv(entries: DataFrame, folder: str, order: str = "ts") -> None:
    """The ledger in order of time, with a mark at the start of the header that tells spreadsheets its encoding."""
    cols = [F.col(c).cast("string").alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(entries.columns)]
    entries.orderBy(order, *[c for c in entries.columns if c != order]).select(*cols).write.mode("overwrite").option("header", True).csv(folder)


def sheet_title(name: str, taken: Iterable[str] = ()) -> str:
    """A title that a spreadsheet accepts, told apart from those taken in any letter case."""
    base = re.sub(r"[\[\]:*?/\\]", "-", name)[:31] or "Sheet"
    title, n, lower = base, 2, {t.lower() for t in taken}
    while title.lower() in lower:
        title, n = f"{base[: 30 - len(str(n))]} {n}", n + 1
    return title


def _parts(rows: Iterator, most: int) -> Iterator[Iterator]:
    """The rows in runs of ``most``, one at least."""
    row, more = next(rows, None), True

    def run() -> Iterator:
        nonlocal row, more
        n = 0
        while row is not None and n < most:
            yield row
            row, n = next(rows, None), n + 1
        more = row is not None

    while more:
        yield run()


def workbook(sheets: dict[str, DataFrame] | DataFrame, path: str, title: str = "Sheet", most: int = MOST_ROWS) -> int:
    """A workbook with a sheet for each entry of ``sheets``, header first; returns the number of rows.

    A table of more than ``most`` rows is continued on further sheets. Rows stream through the
    driver, one partition at a time, to a file of the driver's.
    """
    sheets = sheets if isinstance(sheets, dict) else {title: sheets}
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    line = lambda row: ("<row>" + "".join(map(cell, row)) + "</row>").encode()
    titles: list[str] = []
    total = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in sheets.items():
            safe = df.select(*[X.cell_safe(F.col(c)).alias(c) for c in df.columns])
            for part in _parts(safe.toLocalIterator(), most):
                titles.append(sheet_title(name, titles))
                with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w") as out:
                    out.write(f'<worksheet xmlns="{_SHEETS}"><sheetData>'.encode() + line(df.columns))
                    for row in part:
                        out.write(line(row))
                        total += 1
                    out.write(b"</sheetData></worksheet>")
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_MAIN}.worksheet+xml"/>' for i in range(1, len(titles) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_MAIN}.sheet.main+xml"/>{kinds}</Types>')
        links = lambda targets: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(targets, 1)) + "</Relationships>"
        z.writestr("_rels/.rels", links([("officeDocument", "xl/workbook.xml")]))
        named = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEETS}" xmlns:r="{_OFFICE}"><sheets>{named}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", links([("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(titles) + 1)]))
    return total


def rows_held(path: str) -> dict[str, int]:
    """Rows of each sheet of a workbook below its header, counted in the file."""
    with zipfile.ZipFile(path) as z:
        names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        count = lambda i: sum(chunk.count(b"<row>") for chunk in iter(lambda f=z.open(f"xl/worksheets/sheet{i}.xml"): f.readline(), b""))
        return {n: count(i) - 1 for i, n in enumerate(names, 1)}


def category_workbooks(records: DataFrame, folder: str, category: str = "category") -> dict[str, int]:
    """A workbook for each category, named by its slug, with its number of rows.

    One file a category is the feature; its rows stream through the driver. For large results use ``by_category``.
    """
    slugs = {r["c"]: r["s"] for r in records.select(F.coalesce(category, F.lit("")).alias("c")).distinct().select("c", X.slug(F.col("c")).alias("s")).collect()}
    rest = [c for c in records.columns if c != category]
    return {c: workbook(records.filter(F.coalesce(category, F.lit("")) == c).select(*rest), f"{folder}/{s}.xlsx", c or "None") for c, s in sorted(slugs.items())}


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A checkpoint of several tables, written beside the last one; the marker written last makes it the valid one."""
    spark = next(iter(tables.values())).sparkSession
    last = json.loads(storage.read_text(spark, f"{folder}/_COMPLETE") or '{"version": 0}')["version"]
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/version={last + 1}/{name}")
    storage.write_text(spark, f"{folder}/_COMPLETE", json.dumps({"version": last + 1, "tables": sorted(tables)}))
    if last > 1:
        storage.remove(spark, f"{folder}/version={last - 1}")


def load_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last complete checkpoint, nothing if there is none."""
    marker = storage.read_text(spark, f"{folder}/_COMPLETE")
    held = json.loads(marker) if marker else {"tables": []}
    return {n: spark.read.parquet(f"{folder}/version={held['version']}/{n}") for n in held["tables"]}
