"""List pages as a streaming source whose offset carries the rule by which a run ends.

    spark.dataSource.register(list_pages.ListPages)
    spark.readStream.format("list_pages").options(pages=folder, known=file, mode="update").load()

`pages` is a folder with a file <number>.json for each page, an array of ids, from 1 on; `known` a file of known ids, one in a
line. An offset is the last page read, how many pages up to it held known ids only, and whether the run is over, so a query
that is started again from its checkpoint goes on where it was, and reads no page twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: In update mode a run ends with so many pages in a row, from this page on, on which all ids are known.
KNOWN_PAGES, FROM_PAGE = 2, 2


class ListReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.mode, self.each = options.get("mode", "full"), int(options.get("pagesPerBatch", "10"))
        if self.mode not in ("full", "resume", "update"):
            raise ValueError(f"mode is full, resume or update, not {self.mode}")
        self.pages, self.known_path = options["pages"].rstrip("/"), options.get("known")
        self.known: set[str] | None = None

    def text(self, uri: str) -> str | None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return f.read().decode()

    def ids(self, page: int) -> list[str] | None:
        """The ids of a page; None behind the last one."""
        found = self.text(f"{self.pages}/{page}.json")
        return None if found is None else [str(i) for i in json.loads(found)]

    def is_known(self, ids: list[str]) -> bool:
        if self.known is None:
            self.known = set((self.text(self.known_path) or "").split()) if self.known_path else set()
        return all(i in self.known for i in ids)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0, "known": 0, "over": False}

    def after(self, offset: dict, ids: list[str] | None) -> dict:
        """The offset when the next page, of these ids, has been read."""
        if ids is None:
            return offset | {"over": True}
        page = offset["page"] + 1
        known = offset["known"] + 1 if page >= FROM_PAGE and self.is_known(ids) else 0
        return {"page": page, "known": known, "over": self.mode == "update" and known >= KNOWN_PAGES}

    def rows(self, page: int, ids: list[str]) -> Iterator[tuple]:
        if self.mode != "resume" or not self.is_known(ids):
            yield from ((page, i) for i in ids)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        offset, out = start, []
        for _ in range(self.each):
            if offset["over"]:
                break
            ids = self.ids(offset["page"] + 1)
            offset = self.after(offset, ids)
            if ids is not None:
                out += self.rows(offset["page"], ids)
        return iter(out), offset

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for page in range(start["page"] + 1, end["page"] + 1):
            yield from self.rows(page, self.ids(page) or [])

    def commit(self, end: dict) -> None:
        pass


class ListPages(DataSource):
    """(page, id) of list pages; options pages, known, mode (full, resume, update) and pagesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "list_pages"

    def schema(self) -> str:
        return "page int, id string"

    def simpleStreamReader(self, schema) -> ListReader:  # noqa: N802
        return ListReader(self.options)
