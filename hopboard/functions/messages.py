"""Strict decoding of JSON search events with built-in expressions.

The accepted texts are those a strict, typed JSON reader accepts: one object and nothing after it,
text fields given as JSON strings, the time as a JSON integer that fits a long. Field names match
without regard to case, the last of several equal names wins, null leaves a field unset and unknown
fields are skipped. Spark's typed `from_json` is looser on each of these points, so it is used only
for texts in the usual compact layout; those of them without escapes are not parsed but cut at
their quotes. Every other text is parsed into a map of variants whose types are then checked.

The expressions are SQL texts, as building them call by call takes longer than decoding a small batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual compact layout: {"query":"a","source":"b","ts_ms":1,"event_id":"c"}. Blanks may follow
# the marks and the last field may be missing. The time has at most 18 digits, so it fits a long.
_LAYOUT = (
    r'^\{"query": *+"(TEXT)", *+"source": *+"(TEXT)", *+"ts_ms": *+([1-9][0-9]{0,17}+)'
    r'(?:, *+"event_id": *+"(TEXT)")?+\}\z'
)
_PLAIN_LAYOUT = _LAYOUT.replace("TEXT", r'[^"\\\x00-\x1F]*+')
_ESCAPED_LAYOUT = _LAYOUT.replace("TEXT", r'(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+')

# Bytes that are no UTF-8 each stand for U+FFFD. Seen as characters of one byte, these are first bytes that
# the right ones do not follow, and following ones that no right sequence leads to.
_FIRST = {
    r'[\xC2-\xDF]': [r'[\x80-\xBF]'],
    r'\xE0': [r'[\xA0-\xBF]', r'[\x80-\xBF]'],
    r'[\xE1-\xEC\xEE\xEF]': [r'[\x80-\xBF]', r'[\x80-\xBF]'],
    r'\xED': [r'[\x80-\x9F]', r'[\x80-\xBF]'],
    r'\xF0': [r'[\x90-\xBF]', r'[\x80-\xBF]', r'[\x80-\xBF]'],
    r'[\xF1-\xF3]': [r'[\x80-\xBF]', r'[\x80-\xBF]', r'[\x80-\xBF]'],
    r'\xF4': [r'[\x80-\x8F]', r'[\x80-\xBF]', r'[\x80-\xBF]'],
}
_BAD_FIRST = '|'.join([r'[\xC0\xC1\xF5-\xFF]', *[f"{first}(?!{''.join(rest)})" for first, rest in _FIRST.items()]])
_GOOD_PLACE = '|'.join(
    f"(?<={first}{''.join(rest[:i])}){''.join(rest[i:])}" for first, rest in _FIRST.items() for i in range(len(rest))
)
_BAD_BYTE = rf'(?:{_BAD_FIRST}|(?!{_GOOD_PLACE})[\x80-\xBF])'
_VALID = rf"""
CASE WHEN is_valid_utf8(_given) THEN _given ELSE
  CAST(encode(regexp_replace(decode(CAST(_given AS BINARY), 'ISO-8859-1'), r'{_BAD_BYTE}', '{chr(0xEF)}{chr(0xBF)}{chr(0xBD)}'), 'ISO-8859-1') AS STRING)
END"""

# Escapes of surrogates without their other half stand for U+FFFD. Pairs of backslashes are set aside, so
# that every backslash left starts an escape; the sign that holds their place is refused inside of texts.
_WHOLE_TEXT = r"""
CASE WHEN contains(_raw, r'\u') AND _raw RLIKE r'\\u[dD][89a-fA-F]' AND NOT contains(_raw, '\u0002') THEN
  replace(regexp_replace(regexp_replace(replace(_raw, r'\\', '\u0002'),
    r'(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}', r'\\ufffd'),
    r'\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})', r'\\ufffd'), '\u0002', r'\\')
ELSE _raw END"""

# A compact text becomes its four values, each after a control character, which no value has; any
# other text still starts with its brace.
_CUT = rf"""
CASE WHEN startswith(_text, '{{') THEN
  split(regexp_replace(_text, r'{_PLAIN_LAYOUT}', '\u0001$1\u0001$2\u0001$3\u0001$4'), '\u0001')
END"""

_COMPACT_EVENT = """
CASE WHEN get(_cut, 0) = '' THEN
  named_struct('query', get(_cut, 1), 'source', get(_cut, 2),
               'ts_ms', CAST(get(_cut, 3) AS BIGINT), 'event_id', get(_cut, 4))
END"""

_ESCAPED_EVENT = rf"""
CASE WHEN _text RLIKE r'{_ESCAPED_LAYOUT}' THEN
  from_json(_text, 'query STRING, source STRING, ts_ms BIGINT, event_id STRING')
END"""

# Spark's parser stops after the first complete value. The text is therefore wrapped in a list that
# must go on to a second element holding the text's own hash. A lone `null` is an object without
# fields. U+017F is the one letter beyond A to Z that counts as another case of a letter in a name.
# `get(transform(array(x), name -> …), 0)` names a value, so that it is worked out once.
_HASH = "hex(xxhash64(_text))"
_WRAPPED = f"""concat('[', _text, ',{{"hash":"', {_HASH}, '"}}]')"""
_PARSED_EVENT = rf"""
get(transform(
  array(from_json({_WRAPPED}, 'ARRAY<MAP<STRING, VARIANT>>',
                  map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false'))),
  both -> CASE WHEN size(both) = 2 AND try_variant_get(try_element_at(both[1], 'hash'), '$', 'STRING') = {_HASH} THEN
    get(transform(
      array(filter(
        transform(map_entries(both[0]), entry -> named_struct(
          'name', lower(replace(entry.key, '{chr(0x17F)}', 's')),
          'type', schema_of_variant(entry.value),
          'value', entry.value)),
        field -> field.name IN ('query', 'source', 'ts_ms', 'event_id') AND field.type <> 'VOID')),
      given -> CASE
        WHEN coalesce(exists(given, field -> field.type <> if(field.name = 'ts_ms', 'BIGINT', 'STRING')), false)
          THEN NULL
        ELSE named_struct(
          'query', try_variant_get(try_element_at(filter(given, f -> f.name = 'query'), -1).value, '$', 'STRING'),
          'source', try_variant_get(try_element_at(filter(given, f -> f.name = 'source'), -1).value, '$', 'STRING'),
          'ts_ms', try_variant_get(try_element_at(filter(given, f -> f.name = 'ts_ms'), -1).value, '$', 'BIGINT'),
          'event_id', try_variant_get(try_element_at(filter(given, f -> f.name = 'event_id'), -1).value, '$', 'STRING'))
        END), 0)
    END), 0)"""


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add the four event fields and `well_formed`; the fields are NULL where the text is refused."""
    # Unknown fields may hold the same key twice inside; the result must not depend on the session.
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    columns = [f"`{name}`" for name in messages.columns]
    # The pieces get a projection of their own, as they are used many times. So does the parser: it
    # would keep the cheap steps before it out of generated code.
    return (
        messages.selectExpr(*columns, f"CAST(`{value}` AS STRING) AS _given")
        .selectExpr(*columns, f"{_VALID} AS _raw")
        .selectExpr(*columns, f"{_WHOLE_TEXT} AS _text")
        .selectExpr(*columns, "_text", f"{_CUT} AS _cut")
        .selectExpr(*columns, "_text", f"{_COMPACT_EVENT} AS _compact")
        .selectExpr(*columns, f"coalesce(_compact, {_ESCAPED_EVENT}, {_PARSED_EVENT}) AS _event")
        .selectExpr(
            *columns, "_event.query", "_event.source", "_event.ts_ms",
            "nullif(_event.event_id, '') AS event_id", "_event IS NOT NULL AS well_formed",
        )
    )


def encode_event() -> Column:
    """JSON text of an event; an empty or missing `event_id` is left out."""
    return F.expr("to_json(named_struct('query', query, 'source', source, 'ts_ms', ts_ms, "
                  "'event_id', nullif(event_id, '')))")
