"""EPUB books as a Spark data sink: all of a job's books become visible, or none.

Rows are the documents of books, in the order of path, place and file within a
partition. A task writes each book under a name of its own in a hidden folder,
document by document, so that it holds one chapter at a time. Only when all
tasks are done does the commit move the books to their places and leave a list
of them in ``_exports``; a job that fails takes its hidden folder with it. Books
of attempts that did not count are never moved.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RESULT = "path string, novel_id bigint, chapters bigint, bytes bigint"
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def package(one: Row, items: list[tuple[str, str]], cover: tuple[str, str] | None) -> str:
    """The book's description. items: file and heading of its pages, in order."""
    listed = "".join(f'<item id="p{i}" href="{escape(f)}" media-type="application/xhtml+xml"/>' for i, (f, _) in enumerate(items))
    if cover:
        listed += f'<item id="cover" href="{escape(cover[0])}" media-type="{escape(cover[1])}" properties="cover-image"/>'
    about = f'<dc:identifier id="id">novel-{one["novel_id"]}</dc:identifier><dc:title>{escape(one["title"])}</dc:title>'
    about += "".join(f"<dc:{tag}>{escape(one[c])}</dc:{tag}>" for tag, c in (("creator", "author"), ("subject", "genre")) if one[c])
    spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(items)))
    return f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{about}<dc:language>en</dc:language></metadata><manifest>{listed}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{spine}</spine></package>'


def contents(items: list[tuple[str, str]]) -> str:
    links = "".join(f'<li><a href="{escape(f)}">{escape(h)}</a></li>' for f, h in items)
    return f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'


def write_book(rows: Iterator[Row], out) -> tuple[Row, int]:
    """An EPUB of these documents into an open stream; the first of them, and how many chapters it has."""
    one, items, cover, chapters = None, [], None, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, data, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, how)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        for r in rows:
            one = one or r
            if r["data"] is not None:
                cover = (r["file"], r["media"])
                put(f"OEBPS/{r['file']}", bytes(r["data"]), zipfile.ZIP_STORED)
                continue
            items.append((r["file"], r["heading"]))
            chapters += r["place"] > 0
            put(f"OEBPS/{r['file']}", r["xhtml"])
        put("OEBPS/content.opf", package(one, items, cover))
        put("OEBPS/nav.xhtml", contents(items))
    return one, chapters


@dataclass
class Written(WriterCommitMessage):
    """(hidden name, path, novel_id, chapters, bytes) of a task's books."""

    books: list[tuple[str, str, int, int, int]] = field(default_factory=list)


class BookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.job = options["path"], options["job"]

    def _hidden(self, top: str) -> str:
        return f"{top}/.books-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, top = store_of(self.folder)
        store.create_dir(self._hidden(top), recursive=True)
        done = Written()
        for path, own in itertools.groupby(rows, key=lambda r: r["path"]):
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{self._hidden(top)}/{name}", compression=None) as out:
                one, chapters = write_book(own, out)
            size = store.get_file_info(f"{self._hidden(top)}/{name}").size
            done.books.append((name, path, one["novel_id"], chapters, size))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, top = store_of(self.folder)
        books = [b for m in messages if m is not None for b in m.books]
        for folder in {f"{top}/{path}".rpartition("/")[0] for _, path, *_ in books}:
            store.create_dir(folder, recursive=True)
        for name, path, *_ in books:
            store.move(f"{self._hidden(top)}/{name}", f"{top}/{path}")
        store.create_dir(f"{top}/_exports", recursive=True)
        with store.open_output_stream(f"{top}/_exports/{self.job}.json", compression=None) as out:
            for _, path, novel, chapters, size in books:
                out.write((json.dumps({"path": path, "novel_id": novel, "chapters": chapters, "bytes": size}) + "\n").encode())
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store_of(self.folder))

    def _clear(self, store: fs.FileSystem, top: str) -> None:
        if store.get_file_info(self._hidden(top)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(top))


class Books(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub_books"

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(dict(self.options))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the books; path, novel_id, chapters and bytes of each."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Books)
    rows.write.format("epub_books").option("path", folder).option("job", job).mode("append").save()
    return spark.read.schema(RESULT).json(f"{folder}/_exports/{job}.json")
