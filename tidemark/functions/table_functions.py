"""Table functions for SQL, registered by the queries that use them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F


@F.udtf(returnType="place long, part string")
class PathParts:
    """The parts of a text between slashes, counted from 0; none for NULL."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split("/"))
