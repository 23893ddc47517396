"""Structural comparison of JSON texts, in built-in expressions alone.

A variant's text is compact and has sorted keys; what is left is done on that text. First escaped quotes and backslashes become control
characters, which never occur in JSON as such, so that every quote that is left begins or ends a string. Then numbers are written as
64-bit floats, and volatile fields are cut wherever they stand. Where any field may be cut, brackets, commas and colons inside
strings are hidden in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fields that change without a change of the object.
VOLATILE = {
    "invoice": ("webhooks_delivered_at", "invoice_pdf", "hosted_invoice_url"),
    "charge": ("receipt_url",),
}
_MARKS, _HIDDEN = "{}[],:", "\x04\x05\x06\x07\x0e\x0f"
_BACKSLASH, _QUOTE = "\x02", "\x03"
#: Objects and arrays within each other, and members of one of them, that the value of a volatile field may have to be cut.
DEPTH, MEMBERS = 16, 1000
#: A number that may be beyond 64-bit floats.
_HUGE = "[eE][+]?[0-9]{3}|[0-9]{300}"
#: Whole numbers of few digits are written alike by variants and as floats; others have to be looked at.
_LONG = "[0-9]{16}|[0-9]E|[0-9][.][0-9]"


def take_last_keys(spark: SparkSession) -> None:
    """Let variants of the session take the last value of a repeated key, as JSON readers do, instead of refusing the text."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


#: A text that JSON from elsewhere hardly holds; one that holds it is parsed twice.
_END = "\x10end"


def parsed(text: Column) -> Column:
    """The text as a variant; null if it is not one JSON value and nothing else.

    Spark's parser stops after the first value. In an array that is to end with a mark, only a lone value is followed by the mark. A
    text that holds the mark itself is tried in an object too, which nothing but a lone value fits into as well as into an array.
    """
    if session := SparkSession.getActiveSession():
        take_last_keys(session)
    mark = F.lit('"\\u0010end"')
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")))
    odd = F.contains(text, mark) & F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNull()
    return once(whole, lambda w: F.when((F.try_variant_get(w, "$[1]", "string") == _END) & ~odd, F.try_variant_get(w, "$[0]", "variant")))


def _variant_text(text: Column) -> Column:
    # A number beyond floats becomes a text; such JSON equals nothing.
    return once(F.to_json(parsed(text)), lambda out: F.when(~(F.contains(out, F.lit('Infinity"')) & text.rlike(_HUGE)), out))


def _number(t: Column, strict_ints: bool) -> Column:
    value = t.try_cast("double") + F.lit(0.0)  # no negative zero
    whole = (F.rint(value) == value) & (F.abs(value) < 1e37)
    out = F.when(whole, value.try_cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    return F.when(t.rlike("^-?[0-9]+$"), t).otherwise(out) if strict_ints else out


def _value() -> str:
    inner = '"[^"]*"'
    for _ in range(DEPTH):
        inner = rf'[{{\[](?:[^{{}}\[\]"]++|"[^"]*"|{inner}){{0,{MEMBERS}}}+[}}\]]'
    return rf'(?:"[^"]*"|{inner}|[^"{{}}\[\],]++)'


def _pattern(pair: str) -> str:
    """Matches the field with one comma. A quote that ends a string is not followed by a name, or not preceded by a bracket or comma."""
    return rf"(?<=[{{,]){pair},|,?(?<=[{{,]){pair}"


def canonical_json(data: Column, object_type: Column, strict_ints: bool = False, nulls: bool = True) -> Column:
    """One text for all equal objects: keys sorted, volatile fields of the object type dropped at every depth,
    numbers as 64-bit floats (integers exactly, with `strict_ints`). Null if the text is no JSON or holds a number beyond them.
    `nulls=False` also drops fields that are null. A volatile field stays if its value is an object or array of over MEMBERS
    members or DEPTH levels."""
    text = F.replace(F.replace(_variant_text(data), F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def token(t: Column) -> Column:
        string = t if nulls else F.translate(t, _MARKS, _HIDDEN)
        return F.when(t.startswith('"'), string).when(t.rlike("^[-0-9]"), _number(t, strict_ints)).otherwise(t)

    def by_token(x: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit('("[^"]*"|-?[0-9][-+.0-9eE]*|[^"0-9-]+)'), F.lit(1)), token), "")

    text = once(text, lambda x: F.when(x.rlike(_LONG), by_token(x)).otherwise(x)) if nulls else by_token(text)
    cut = F
    for kind, names in VOLATILE.items():
        cut = cut.when(object_type == kind, F.regexp_replace(text, _pattern(rf'"(?:{"|".join(names)})":{_value()}'), ""))
    text = cut.otherwise(text)
    if not nulls:
        text = F.regexp_replace(text, _pattern('"[^"]*":null(?=[,}])'), "")
        text = F.translate(text, _HIDDEN, _MARKS)
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def same_json(a: str, b: str, object_type: Column) -> Column:
    """json_equal() of two columns, for rows most of which are equal: texts that are equal byte for byte need only be JSON, and
    those that are equal as variants are compared no further. Null and text that is no JSON equal nothing."""
    left, right = _variant_text(F.col(a)), _variant_text(F.col(b))
    valid = F.when(F.col(a).rlike(_HUGE), left.isNotNull()).otherwise(parsed(F.col(a)).isNotNull())
    differ = (left == right) | json_equal(F.col(a), F.col(b), object_type)
    return F.coalesce(F.when(F.col(a) == F.col(b), valid).otherwise(differ), F.lit(False))


def digest(data: Column, object_type: Column) -> Column:
    """A 64-bit hash that structurally equal objects share; null if the text is no JSON. Objects of types without volatile
    fields may differ in it though equal, if one writes numbers with an exponent; comparing their texts tells."""
    text = F.when(object_type.isin(*VOLATILE), canonical_json(data, object_type)).otherwise(_variant_text(data))
    return once(text, lambda x: F.when(x.isNotNull(), F.xxhash64(x)))


def json_equal(a: Column, b: Column, object_type: Column, strict_ints: bool = False) -> Column:
    """Whether two JSON texts are structurally equal. Text that is no JSON equals nothing, not even itself."""
    left, right = canonical_json(a, object_type, strict_ints), canonical_json(b, object_type, strict_ints)
    return F.coalesce(left == right, F.lit(False))
