"""Chunkers as table functions of SQL: SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_recursive(d.text, 500, 50) c.

They run over Arrow batches and give (chunk_index, chunk_count, content), as the DataFrame forms do; null texts have no chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.operators import chunking
from tessera.session import ship

CHUNK = "chunk_index int, chunk_count int, content string"


def of(splitter: Callable[..., list[str]]) -> type:
    """A table function's handler around any splitter of (text, ...) to a list of texts."""

    class Chunks:
        def eval(self, text: str, *how) -> Iterator[tuple[int, int, str]]:
            if text is not None:
                found = splitter(text, *how)
                for k, x in enumerate(found):
                    yield k, len(found), x

    return Chunks


def _fixed(text: str, size: int, overlap: int = 0) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size - overlap)]


def _sentences(text: str, size: int, overlap: int = 0) -> list[str]:
    import re

    parts = [" ".join(re.split(r"[ \t\n\r\f\x0B]+", s)).strip(" ") for s in re.split(r"[.!?]+", text)]
    parts = [s for s in parts if s]
    return [". ".join(parts[i : i + size]) for i in range(0, len(parts), size - overlap)]


#: Names in SQL: (text, size, overlap) but for chunk_adaptive (text, target) and chunk_code (source, size).
SPLITTERS: dict[str, Callable[..., list[str]]] = {
    "chunk_fixed": _fixed, "chunk_recursive": chunking.split_recursive, "chunk_sentences": _sentences, "chunk_adaptive": chunking.split_adaptive, "chunk_code": chunking.split_code,
}


def register(spark: SparkSession, splitters: dict[str, Callable[..., list[str]]] | None = None) -> list[str]:
    """Registers the library's chunkers, or others, as table functions of the session; gives their names."""
    ship(spark)
    names = SPLITTERS if splitters is None else splitters
    for name, splitter in names.items():
        spark.udtf.register(name, udtf(of(splitter), returnType=CHUNK, useArrow=True))
    return list(names)
