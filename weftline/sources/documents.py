"""Documents as Spark data sources: GraphML, HAR and workbooks, one whole document for each partition of the rows written.

Each task writes its document under a name of its own and reports it; the driver's commit gives all of them their
names, an abort deletes them. So a reader sees the documents of finished writes only, and a task that ran twice
leaves one. Paths are opened through Arrow's file systems.

    documents.register(spark)
    dealt(edges).write.format("graphml").mode("overwrite").save(path)
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix = path.rstrip("/"), overwrite, suffix

    def document(self, out: io.RawIOBase, rows: Iterator[Row]) -> int:
        """Write the rows' document; their number."""
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        files, path = _place(self.path)
        name = f"{path}/_unfinished/{uuid.uuid4().hex}"
        files.create_dir(f"{path}/_unfinished", recursive=True)
        try:
            with files.open_output_stream(name) as out:
                n = self.document(out, iterator)
        except BaseException:
            files.delete_file(name)
            raise
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _place(self.path)
        files.create_dir(path, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith(self.suffix):
                    files.delete_file(f.path)
        some = [m for m in messages if m is not None and m.rows] or [m for m in messages if m is not None][:1]  # without rows, one empty document
        for k, m in enumerate(some):
            files.move(m.file, f"{path}/part-{k:05d}-{m.file.rsplit('/', 1)[1][:8]}{self.suffix}")
        self._clear(files, path, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path), messages)

    @staticmethod
    def _clear(files: fs.FileSystem, path: str, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and files.get_file_info(m.file).type == fs.FileType.File:
                files.delete_file(m.file)
        rest = f"{path}/_unfinished"
        if files.get_file_info(rest).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(rest)):
            files.delete_dir(rest)


class _GraphMLWriter(_Writer):
    """Rows (src, dst) and any further columns as data of the edges."""

    def document(self, out, rows):
        put = lambda s: out.write(s.encode())
        put('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        seen, n, keys = set(), 0, None
        for r in rows:
            d = r.asDict()
            if keys is None:
                keys = [c for c in d if c not in ("src", "dst")]
                for c in keys:
                    put(f'<key id={quoteattr(c)} for="edge" attr.name={quoteattr(c)} attr.type="string"/>\n')
                put('<graph edgedefault="directed">\n')
            for node in (d["src"], d["dst"]):
                if node not in seen:
                    seen.add(node)
                    put(f"<node id={quoteattr(str(node))}/>\n")
            data = "".join(f"<data key={quoteattr(c)}>{escape(str(d[c]))}</data>" for c in keys if d[c] is not None)
            put(f"<edge source={quoteattr(str(d['src']))} target={quoteattr(str(d['dst']))}>{data}</edge>\n")
            n += 1
        if keys is None:
            put('<graph edgedefault="directed">\n')
        put("</graph>\n</graphml>\n")
        return n


class _HarWriter(_Writer):
    """Rows with an ``entry`` (JSON of one exchange) as a log."""

    def document(self, out, rows):
        out.write(b'{"log": {"version": "1.2", "creator": {"name": "weftline", "version": "1"}, "entries": [')
        n = 0
        for r in rows:
            json.loads(r["entry"])  # an entry that is no JSON fails the write
            out.write((b",\n" if n else b"\n") + r["entry"].encode())
            n += 1
        out.write(b"\n]}}\n")
        return n


#: Rows that a sheet of a workbook may have.
SHEET_ROWS = 1_048_576
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


class _WorkbookWriter(_Writer):
    """Rows (sheet, cells: array of strings), those of a sheet one behind the other; a sheet that is full goes on in another."""

    def document(self, out, rows):
        sheets: list[str] = []
        n, part, now, left = 0, None, None, 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

            def close():
                if part is not None:
                    part.write(b"</sheetData></worksheet>")
                    part.close()

            for r in rows:
                if r["sheet"] != now or not left:
                    close()
                    title = r["sheet"] if r["sheet"] != now else f"{now} {sum(s.split(' ')[0] == now for s in sheets) + 1}"
                    now, left = r["sheet"], SHEET_ROWS
                    sheets.append(title)
                    part = z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True)
                    part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_NS}><sheetData>'.encode())
                cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_legal(c))}</t></is></c>' if c is not None else "<c/>" for c in r["cells"])
                part.write(f"<row>{cells}</row>".encode())
                n, left = n + 1, left - 1
            close()
            if not sheets:
                sheets.append("empty")
                z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_NS}><sheetData/></worksheet>')
            ids = range(1, len(sheets) + 1)
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {_NS} xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(ids, sheets)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids) + "</Relationships>")
            z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in ids) + "</Types>")
        return n


def _legal(s: str) -> str:
    return "".join(ch for ch in s if ch >= " " or ch in "\t\n\r")


class GraphML(DataSource):
    suffix, kind = ".graphml", _GraphMLWriter

    @classmethod
    def name(cls) -> str:
        return cls.suffix[1:]

    def schema(self):
        raise NotImplementedError("documents are written only")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return self.kind(self.options["path"], overwrite, self.suffix)


class Har(GraphML):
    suffix, kind = ".har", _HarWriter


class Workbook(GraphML):
    suffix, kind = ".xlsx", _WorkbookWriter


def register(spark: SparkSession) -> None:
    for source in (GraphML, Har, Workbook):
        spark.dataSource.register(source)


#: Rows of a document, about: a reader takes a document whole.
DOCUMENT_ROWS = 50_000


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in partitions for documents of about DOCUMENT_ROWS rows, four at least: more rows make more documents, not larger ones."""
    return rows.repartition(max(4, -(-rows.count() // DOCUMENT_ROWS)))


def write(rows: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Write ``rows`` as documents of format graphml, har or xlsx; one for each of their partitions that has rows."""
    register(rows.sparkSession)
    rows.write.format(fmt).mode(mode).save(path)
