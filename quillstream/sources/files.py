"""A sink that writes a file for each row: `name`, `content` to path/name + suffix.

Each attempt of a task writes to a folder of its own below path/_writing-...; the driver moves the files of the attempts that count when
all tasks are done, so an attempt that failed or was run twice leaves nothing.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..store import opened

#: Files that are moved at once.
MOVERS = 16


@dataclass
class Done(WriterCommitMessage):
    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.writing = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows):
        fs, top = opened(self.path)
        context = TaskContext.get()
        mine = f"{self.writing}/{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(f"{top}/{mine}", recursive=True)
        names, seen = [], set()
        for r in rows:
            name = quote(r["name"], safe=" !@#$&'()+,;=[]{}~") + self.suffix
            if name in seen:
                raise ValueError(f"{name} comes twice")
            seen.add(name)
            with fs.open_output_stream(f"{top}/{mine}/{name}") as f:
                f.write(bytes(r["content"]))
            names.append(name)
        return Done(mine, names)

    def commit(self, messages):
        fs, top = opened(self.path)
        try:
            done = [(m.folder, n) for m in messages if m for n in m.names]
            if len({n for _, n in done}) < len(done):
                raise ValueError("a name comes twice")
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda x: fs.move(f"{top}/{x[0]}/{x[1]}", f"{top}/{x[1]}"), done))
        finally:
            self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self):
        fs, top = opened(self.path)
        try:
            fs.delete_dir(f"{top}/{self.writing}")
        except FileNotFoundError:
            pass


class Files(DataSource):
    @classmethod
    def name(cls):
        return "files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options)
