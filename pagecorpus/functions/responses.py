"""Parsing of landed translation-service responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagecorpus.functions.text import _col, utrim


def response_fields(json_text: Column | str) -> Column:
    """Struct ``(text, status)`` out of ``[[[text, ...], ...], ...]``.

    The first item of every inner array is taken when it is a string; other groups are
    skipped. status: ok, missing_text (nothing left after trimming), invalid_response.
    """
    root = F.try_parse_json(_col(json_text))
    groups = F.try_variant_get(root, "$[0]", "array<variant>")

    def first_string(group: Column) -> Column:
        head = F.try_variant_get(group, "$[0]", "variant")
        text = F.try_variant_get(head, "$", "string")
        return F.when(F.schema_of_variant(head) == "STRING", text).otherwise("")

    text = utrim(F.array_join(F.transform(groups, first_string), ""))
    status = (
        F.when(groups.isNull(), "invalid_response").when(text == "", "missing_text").otherwise("ok")
    )
    return F.struct(F.when(status == "ok", text).alias("text"), status.alias("status"))
