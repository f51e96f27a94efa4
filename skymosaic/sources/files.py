"""Files by byte ranges, in any store that pyarrow can open (local, HDFS, object stores)."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, of the `file:/` form that Spark lists, or of a plain path."""
    plain = re.match(r"file:/+(.*)", path)
    return fs.FileSystem.from_uri("/" + plain[1] if plain else path)


class Ranges:
    """Bytes of one file. Small reads go through pages, so a header costs one or two; `fetched` counts the bytes that were read."""

    def __init__(self, path: str, page: int = 1 << 15):
        filesystem, at = located(path)
        self.file = filesystem.open_input_file(at)
        self.size, self.page, self.fetched = self.file.size(), page, 0
        self.pages: dict[int, bytes] = {}

    def read(self, at: int, n: int) -> bytes:
        """n bytes; ValueError where the file ends before."""
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("the file ends too early")
        if n > self.page:
            self.fetched += n
            return self.file.read_at(n, at)
        out = b""
        for k in range(at // self.page, (at + n - 1) // self.page + 1):
            if k not in self.pages:
                if len(self.pages) >= 64:
                    self.pages.clear()
                self.pages[k] = self.file.read_at(min(self.page, self.size - k * self.page), k * self.page)
                self.fetched += len(self.pages[k])
            out += self.pages[k]
        skip = at % self.page
        return out[skip : skip + n]

    def close(self) -> None:
        self.file.close()


class Held:
    """The same of bytes that are held."""

    def __init__(self, content: bytes):
        self.content, self.size, self.fetched = content, len(content), 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("the file ends too early")
        self.fetched += n
        return self.content[at : at + n]

    def close(self) -> None:
        pass
