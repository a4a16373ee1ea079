"""Bytes to text with the encoding found out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.functions.arrow import with_mapped


def _decode(data: bytes) -> tuple[str | None, str | None, str | None]:
    if data[:3] == b"\xef\xbb\xbf":
        order = ["utf-8-sig"]
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ["utf-16"]
    else:
        order = ["utf-8", "cp932", "shift_jis", "utf-16"]
    for name in order:
        try:
            return data.decode(name), name, None
        except UnicodeDecodeError as e:
            error = str(e)
    if len(order) == 1:
        return None, order[0], error
    return data.decode("utf-8", "replace"), "utf-8-replace", None


def decode_text(rows: DataFrame, column: str = "content") -> DataFrame:
    """Adds text, encoding and error. Valid UTF-8 without a mark stays in the JVM; the rest is tried as marked, then as
    cp932, shift_jis, utf-16, then with replacements. Broken marked files have no text but an error."""
    data = F.col(column)
    plain = F.is_valid_utf8(data.cast("string")) & ~F.hex(F.substring(data, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    none = F.lit(None).cast("string")
    rows = with_mapped(rows.withColumn("__raw", F.when(~plain, data)), "__raw", "__parts", lambda v: list(_decode(v)), "array<string>")
    part = lambda i: F.get("__parts", F.lit(i))
    return rows.withColumns(
        {
            "text": F.when(plain, data.cast("string")).otherwise(part(0)),
            "encoding": F.when(plain, F.lit("utf-8")).otherwise(part(1)),
            "error": F.when(plain, none).otherwise(part(2)),
        }
    ).drop("__raw", "__parts")
