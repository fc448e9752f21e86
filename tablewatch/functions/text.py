"""Message text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = re.compile(r"%(?:\.(\d)f|[ds%])")


def fixed(value: Column, digits: int) -> Column:
    """A number with that many decimals, exact ties to even (as in most languages, unlike %f here)."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def say(template: str, *args: Column | str) -> Column:
    """``format_string`` whose %.Nf fields use ``fixed``."""
    columns = [F.col(a) if isinstance(a, str) else a for a in args]
    pieces, at = [], 0
    for spec in _SPEC.finditer(template):
        if spec.group() == "%%":
            continue
        digits = spec.group(1)
        pieces.append(columns[at] if digits is None else fixed(columns[at], int(digits)))
        at += 1
    return F.format_string(_SPEC.sub(lambda m: "%s" if m.group(1) else m.group(), template), *pieces)
