"""JSON text read as VARIANT, so that a field's own JSON type stays visible.

A quoted number, a key with null and a missing key all differ here, which a
``from_json`` under a DOUBLE schema cannot tell apart.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkbrief.functions.text import strip


def json_value(content: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; null otherwise.

    A parser by itself stops behind the first value and lets any text follow it. Read as a list that the
    text's own digest closes, which no text can hold, the text must fill exactly the place before it.
    """
    mark = F.sha2(content, 256)
    listed = F.try_parse_json(F.concat(F.lit("["), content, F.lit(',"'), mark, F.lit('"]')))
    alone = F.try_variant_get(listed, "$[1]", "string") == mark
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def json_object(content: Column) -> Column:
    """VARIANT of a JSON object; null for bad JSON, lists, plain values and objects with text behind them."""
    text = strip(content)
    return F.when(text.startswith("{"), json_value(text))


def is_list(content: Column) -> Column:
    """Whether a text is one JSON list and nothing else."""
    text = strip(content)
    return F.coalesce(text.startswith("[") & json_value(text).isNotNull(), F.lit(False))


def json_field(doc: Column, name: str, as_type: str = "string") -> Column:
    return F.try_variant_get(doc, f"$.{name}", as_type)


def _kind(doc: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))


def has_key(doc: Column, name: str) -> Column:
    """True if the key is there and its value is not JSON null."""
    return F.coalesce(_kind(doc, name) != "VOID", F.lit(False))


def is_number(doc: Column, name: str) -> Column:
    return F.coalesce(_kind(doc, name).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def is_string(doc: Column, name: str) -> Column:
    return F.coalesce(_kind(doc, name) == "STRING", F.lit(False))


def truthy(doc: Column, name: str) -> Column:
    """Python truth of a field: absent, null, false, 0, "" and empty containers are false."""
    kind = _kind(doc, name)
    text = json_field(doc, name)
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", json_field(doc, name, "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(json_field(doc, name, "double") != 0.0)
    )
