"""Strands under masks: of several forms of a chunk the one that breaks the fewest rules is taken, and says which it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.functions import rules as R
from helixframe.functions import strand as S


def mask_digits(mask: int) -> str:
    """What the hexadecimal digits 0 to f become when each has a mask of four bits added."""
    if not 0 <= mask < 16:
        raise ValueError("a mask has four bits")
    return "".join(S.HEX[i ^ mask] for i in range(16))


def masked_strand(digits: Column, mask: int) -> Column:
    """Two bases for the mask, and those of the masked digits.  A mask with unequal halves breaks runs of one base up."""
    plain = S.hex_to_strand(digits if mask == 0 else F.translate(digits, S.HEX, mask_digits(mask)))
    return F.concat(F.lit(S.pair(mask)), plain)


def unmasked_digits(strand: Column) -> Column:
    """The digits of a masked strand; null if it isn't one."""
    digits, out = F.lower(F.hex(S.from_strand(F.substring(strand, 3, 1 << 20)))), None
    for mask in range(16):
        fits = strand.startswith(S.pair(mask))
        form = F.translate(digits, S.HEX, mask_digits(mask))
        out = F.when(fits, form) if out is None else out.when(fits, form)
    return out


def _screened(rows: DataFrame, masks: Sequence[int], digits: str) -> DataFrame:
    """screened_strands() by the default rules: all forms of a batch are made and judged at once.  A form is the masked digits behind the mask of a zero."""
    names = [c for c in rows.columns if c != digits]
    schema = StructType([rows.schema[c] for c in names]).add("mask", "integer").add("strand", "string").add("error_prob", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ends, valid = S._held(batch.column(len(names)))
            n = np.diff(ends)
            plain = np.zeros(len(held) + len(n), np.uint8)
            plain[np.arange(len(held)) + np.repeat(np.arange(len(n)) + 1, n)] = _DIGITS[held]
            forms = [S._built(pa.string(), _PAIRS[plain ^ m], 2 * (n + 1), np.ones(len(n), bool)) for m in masks]
            errors = np.round(np.stack([R.default_errors([x if ok else None for x, ok in zip(f.to_pylist(), valid)]) for f in forms]), 6)
            best, at = errors.argmin(0), np.arange(len(n))
            strands = pc.if_else(pa.array(valid), pa.concat_arrays(forms).take(pa.array(best * len(n) + at)), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.array(masks, np.int32)[best]), strands, pa.array(errors[best, at])], schema.names)

    return rows.select(*[F.col(f"`{c}`") for c in names], F.lower(F.col(digits)).alias("_digits")).mapInArrow(run, schema)


_DIGITS = np.zeros(256, np.uint8)
_DIGITS[list(S.HEX.encode())] = range(16)
_PAIRS = np.frombuffer("".join(map(S.pair, range(16))).encode(), np.uint16)


def screened_strands(rows: DataFrame, masks: Sequence[int], digits: str = "chunk_hex", rules: Callable[[Column], Column] = R.default_rules) -> DataFrame:
    """Rows with mask, strand and error_prob in place of the digits: the mask with the least sum of rules, the earlier one of equals."""
    if rules is R.default_rules:
        return _screened(rows, masks, digits)
    kept = [F.col(c) for c in rows.columns if c != digits]
    forms = rows.select(*kept, *[masked_strand(F.col(digits), m).alias(f"_s{i}") for i, m in enumerate(masks)])
    scored = [F.struct(F.round(rules(F.col(f"_s{i}")), 6).alias("error_prob"), F.lit(i).alias("i"), F.lit(m).alias("mask"), F.col(f"_s{i}").alias("strand")) for i, m in enumerate(masks)]
    best = forms.select(*kept, F.array_min(F.array(*scored)).alias("_best"))
    return best.select(*kept, "_best.mask", "_best.strand", "_best.error_prob")
