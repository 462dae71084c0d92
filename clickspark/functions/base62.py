"""Base62 short codes and the 64-bit id layout, as Catalyst expressions (no Python UDF).

Id layout (fixed values): 41-bit milliseconds since 2024-01-01T00:00:00Z, 5-bit datacenter,
5-bit worker, 12-bit sequence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical codes.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
EPOCH_MS = 1704067200000
SEQUENCE_BITS = 12
WORKER_BITS = 5
DATACENTER_BITS = 5

WORKER_SHIFT = SEQUENCE_BITS
DATACENTER_SHIFT = SEQUENCE_BITS + WORKER_BITS
TIMESTAMP_SHIFT = SEQUENCE_BITS + WORKER_BITS + DATACENTER_BITS
MAX_DIGITS = 11  # 62^11 > 2^63: every non-negative BIGINT fits in 11 digits


def _sql(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def encode(num: Column | str) -> Column:
    """BIGINT -> base62 text, most significant digit first; ``0`` -> ``'0'``; negatives -> NULL.

    Digit ``i`` is ``(num div 62^i) % 62`` for ``i = 10 .. 0``; leading zeros are trimmed."""
    n = _sql(num).cast("bigint")
    digits = F.aggregate(
        F.sequence(F.lit(MAX_DIGITS - 1), F.lit(0), F.lit(-1)),
        F.lit(""),
        lambda acc, i: F.concat(
            acc,
            F.lit(ALPHABET).substr(
                (F.pmod(_int_div(n, F.pow(F.lit(62), i).cast("bigint")), F.lit(62)) + 1).cast("int"), F.lit(1)),
        ),
    )
    trimmed = F.ltrim(digits, F.lit("0"))
    return F.when(n < 0, F.lit(None).cast("string")).when(trimmed == "", F.lit("0")).otherwise(trimmed)


def _int_div(a: Column, b: Column) -> Column:
    """Exact BIGINT division (``a div b``) for non-negative operands: ``a - a % b`` is a multiple
    of ``b``, so the DECIMAL quotient is an exact integer (a DOUBLE quotient would round above 2^53)."""
    return ((a - F.pmod(a, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("bigint")


def decode_value(code: Column | str) -> Column:
    """Base62 text -> BIGINT; NULL when empty, on an invalid character or above 2^63-1."""
    c = _sql(code)
    return F.when(decode_error(c).isNull(), _fold(c))


def _fold(c: Column) -> Column:
    """``acc * 62 + digit`` over the characters; NULL once the value leaves BIGINT."""
    return F.aggregate(
        F.split(c, ""), F.lit(0).cast("bigint"),
        lambda acc, ch: F.try_add(F.try_multiply(acc, F.lit(62).cast("bigint")),
                                  (F.instr(F.lit(ALPHABET), ch) - 1).cast("bigint")),
    )


def decode_error(code: Column | str) -> Column:
    """Why a code does not decode: ``empty``, ``invalid_character``, ``overflow``; NULL if fine."""
    c = _sql(code)
    return (F.when(c.isNull() | (c == ""), F.lit("empty"))
            .when(~c.rlike("^[0-9A-Za-z]+$"), F.lit("invalid_character"))
            .when(_fold(c).isNull(), F.lit("overflow")))


def compose_id(ms_since_epoch: Column, datacenter: Column, worker: Column, sequence: Column) -> Column:
    """Pack the id fields into one BIGINT."""
    return (F.shiftleft(ms_since_epoch.cast("bigint"), TIMESTAMP_SHIFT)
            .bitwiseOR(F.shiftleft(datacenter.cast("bigint"), DATACENTER_SHIFT))
            .bitwiseOR(F.shiftleft(worker.cast("bigint"), WORKER_SHIFT))
            .bitwiseOR(sequence.cast("bigint")))


def id_fields(id_col: Column) -> dict[str, Column]:
    """Unpack an id: creation time, datacenter, worker and sequence."""
    ms = F.shiftright(id_col, TIMESTAMP_SHIFT)
    return {
        "created_ms": ms + F.lit(EPOCH_MS),
        "datacenter": F.shiftright(id_col, DATACENTER_SHIFT).bitwiseAND(F.lit((1 << DATACENTER_BITS) - 1)),
        "worker": F.shiftright(id_col, WORKER_SHIFT).bitwiseAND(F.lit((1 << WORKER_BITS) - 1)),
        "sequence": id_col.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1)),
    }
