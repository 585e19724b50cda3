"""Sizes in bytes as text, and the scan settings that a partition size stands for."""

from __future__ import annotations

import re
import resource

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units are powers of 1024.
UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}


def parse_size(text: str) -> int:
    """Bytes of ``200MB`` or ``1.5 gb``; ValueError if malformed or not above 0."""
    m = re.fullmatch(r"([\d.]+)\s*([KMGT]B|B)", text.strip().upper())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    n = int(float(m[1]) * 1024 ** UNITS[m[2]])
    if n <= 0:
        raise ValueError(f"a size is above 0: {text!r}")
    return n


def format_size(n: float) -> str:
    """Whole bytes, or two decimals of the largest unit that fits."""
    power = max((p for p in UNITS.values() if n >= 1024**p), default=0)
    unit = next(u for u, p in UNITS.items() if p == power)
    return f"{int(n)}B" if not power else f"{n / 1024**power:.2f}{unit}"


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.2f}%" if whole else "N/A"


def scan_conf(partition_size: str | int) -> dict[str, str]:
    """Settings for scans in tasks of about this many bytes."""
    n = partition_size if isinstance(partition_size, int) else parse_size(partition_size)
    return {"spark.sql.files.maxPartitionBytes": str(n), "spark.sql.files.openCostInBytes": str(min(n, 4 << 20))}


def peak_memory_mb() -> float:
    """The driver process's peak resident memory."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def _hundredths(n: Column, d: Column | int) -> Column:
    """n / d with two decimals, as text; halves go to the even digit, as Python's formats do, and Java's don't."""
    n, d = n.cast("decimal(27,0)") * 100, (F.lit(d) if isinstance(d, int) else d).cast("decimal(20,0)")
    rest = n % d
    q = ((n - rest) / d).cast("decimal(27,0)")
    q = q + F.when((2 * rest > d) | ((2 * rest == d) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(q / 100).cast("string"), F.lit("."), F.lpad((q % 100).cast("int").cast("string"), 2, "0"))


def size_text(n: Column) -> Column:
    """``format_size`` of a column of whole numbers from 0 on."""
    out = F.concat(n.cast("long").cast("string"), F.lit("B"))
    for unit, power in UNITS.items():
        if power:
            out = F.when(n >= 1024**power, F.concat(_hundredths(n, 1024**power), F.lit(unit))).otherwise(out)
    return out


def size_of(text: Column) -> Column:
    """``parse_size`` of a column; null where the text is no size above 0."""
    upper = F.upper(F.trim(text))
    factor = F.lit(None).cast("double")
    unit = F.regexp_extract(upper, r"^[\d.]+\s*([KMGT]?B)$", 1)
    for u, power in UNITS.items():
        factor = F.when(unit == u, F.lit(float(1024**power))).otherwise(factor)
    n = (F.regexp_extract(upper, r"^([\d.]+)", 1).try_cast("double") * factor).cast("long")
    return F.when(n > 0, n)


def percent_text(part: Column, whole: Column) -> Column:
    """``percent`` of columns of whole numbers from 0 on."""
    return F.when(whole != 0, F.concat(_hundredths(100 * part, whole), F.lit("%"))).otherwise("N/A")
