"""Lines of whole texts that can matter to a scanner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as patterns of Spark have it; the other syntax leaves out one character.
BLANK = r"[\s\x0b]"


def found_lines(text: str, pattern: str) -> Column:
    """The lines of a text in which a pattern in RE2's syntax is found: structs of line (from 0) and content; none for null.

    One automaton reads the lines of an Arrow batch once, however many words the pattern has; Spark's own expressions
    read a line again for each of them. It is meant to choose the lines on which the exact patterns are then tried.
    """

    def pick(texts: pa.Array) -> pa.Array:
        split = pc.split_pattern(texts, "\n")
        content, size = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, found = size.cumsum(), pc.match_substring_regex(content, pattern)
        at = np.flatnonzero(found.to_numpy(zero_copy_only=False))
        of = np.searchsorted(end, at, side="right")
        line = pa.array((at - (end - size)[of]).astype(np.int32))
        kept = pa.StructArray.from_arrays([line, content.filter(found).cast(pa.string())], ["line", "content"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32)), kept)

    return F.arrow_udf(pick, "array<struct<line: int, content: string>>")(text)
