"""JSON texts that are taken only if they are right to the last byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column, max_bytes: int) -> Column:
    """struct(value variant, fault string) of a text that must be one JSON document.

    fault: "missing" for null, "too long" for more bytes than allowed (such a text is not
    parsed), "malformed" for what is no JSON, has a name twice in an object, a number that
    JSON does not know, or anything after its end; else null, and then value is not.
    """
    fits = F.octet_length(text) <= max_bytes
    # Within an array, only a comma or a bracket of its own can bring a text more than one document; within an object, neither can.
    held = F.try_parse_json(F.when(fits, F.concat(F.lit("["), text, F.lit("]"))))
    value = F.try_variant_get(held, "$[0]", "variant")
    alone = F.try_parse_json(F.when(fits, F.concat(F.lit('{"x":'), text, F.lit("}")))).isNotNull() & F.try_variant_get(held, "$[1]", "variant").isNull()
    fault = F.when(text.isNull(), "missing").when(~fits, "too long").when(value.isNull() | ~alone, "malformed")
    return F.struct(F.when(fault.isNull(), value).alias("value"), fault.alias("fault"))
