"""An input contract in JSON Schema keywords, compiled to one array column of messages."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTRACT


def load(path: str | Path | None) -> dict:
    """A contract from a JSON Schema file, decimals kept as written; the built-in one without a path."""
    return json.loads(Path(path).read_text(), parse_float=str) if path else CONTRACT


def country_codes(spark: SparkSession) -> list[str]:
    """The officially assigned two-letter codes that the Java runtime knows."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def quoted(c: Column) -> Column:
    """Text as messages show it: in single quotes, or in double ones if it holds single ones only; None for null."""
    text = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.isNull(), F.lit("None")).when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


def _number(c: Column) -> Column:
    return c.try_cast("decimal(38,18)")


def _checks(name: str, rules: dict) -> Iterable[Column]:
    """A message, or null, for each keyword of a field in order."""
    c, numeric = F.col(name), rules.get("type") == "number"
    here = F.coalesce(_number(c).isNotNull() if numeric else c.isNotNull(), F.lit(False))
    shown = F.when(here, F.concat(F.lit("Decimal('"), F.trim(c), F.lit("')"))).otherwise(quoted(c)) if numeric else quoted(c)
    say = lambda bad, *text: F.when(bad, F.concat(F.lit(f"{name}: "), shown, *map(F.lit, text)))
    for key, rule in rules.items():
        if key == "type":
            yield say(~here, f" is not of type '{rule}'")
        elif key == "pattern":
            yield say(here & ~c.rlike("(?U)" + rule), f" does not match {rule!r}")
        elif key == "enum":
            yield say(~F.coalesce(c.isin(rule), F.lit(False)), f" is not one of {rule!r}")
        elif key == "exclusiveMinimum":
            yield say(here & (_number(c) <= F.lit(str(rule)).cast("decimal(38,18)")), f" is less than or equal to the minimum of {rule}")
        elif key == "multipleOf":
            yield say(here & (_number(c) % F.lit(str(rule)).cast("decimal(38,18)") != 0), f" is not a multiple of Decimal('{rule}')")
        elif key == "minLength":
            yield say(here & (F.char_length(c) < rule), " is too short")
        elif key == "maxLength":
            yield say(here & (F.char_length(c) > rule), " is too long")


#: Columns that a source adds to say how records were received: their keys, and values of text fields that are no text.
AS_RECEIVED = ("record_keys", "record_other")


def _property(name: str, rules: dict, received: bool) -> Iterable[Column]:
    """_checks of a field; of a record as received, none for a key that it lacks, and type and enum alone for a value that is no text."""
    if not received:
        yield from _checks(name, rules)
        return
    there, other = F.array_contains("record_keys", name), F.col("record_other")[name]
    for check in _checks(name, rules):
        yield F.when(there & other.isNull(), check)
    if "type" in rules:
        yield F.when(other.isNotNull(), F.concat(F.lit(f"{name}: "), other, F.lit(f" is not of type '{rules['type']}'")))
    if "enum" in rules:
        yield F.when(other.isNotNull(), F.concat(F.lit(f"{name}: "), other, F.lit(f" is not one of {rules['enum']!r}")))


def _messages(columns: list[str], codes: list[str], contract: dict) -> tuple[list[Column], Column, list[Column]]:
    """(texts for missing fields, an array of texts for extra ones, texts for values); texts are null where there is nothing to say."""
    received, names = all(c in columns for c in AS_RECEIVED), [c for c in columns if c not in AS_RECEIVED]
    text = lambda n: F.lit(f"record: '{n}' is a required property")
    required, known = contract.get("required", []), contract["properties"]
    missing = [F.when(~F.array_contains("record_keys", n), text(n)) for n in required] if received else [text(n) for n in required if n not in names]
    unknown = F.array().cast("array<string>")
    if contract.get("additionalProperties") is False:
        unknown = F.array_except("record_keys", F.array(*map(F.lit, known))) if received else F.array(*(F.lit(n) for n in names if n not in known)).cast("array<string>")
    extra = F.transform(unknown, lambda n: F.concat(F.lit("record: Additional properties are not allowed ('"), n, F.lit("' was unexpected)")))
    values = [c for name, rules in known.items() if name in names for c in _property(name, rules, received)]
    date, country = F.col("transaction_date"), F.col("country_code")
    values.append(F.when((date != "") & date.try_cast("timestamp").isNull(), F.concat(F.lit("transaction_date: invalid calendar datetime "), date)))
    values.append(F.when((country != "") & ~country.isin(codes), F.concat(F.lit("country_code: invalid assigned ISO code "), country)))
    return missing, extra, values


def error_text(columns: list[str], codes: list[str], contract: dict = CONTRACT) -> Column:
    """The messages of errors() in one text, or null; their checks run in compiled code."""
    missing, extra, values = _messages(columns, codes, contract)
    return F.nullif(F.concat_ws("; ", *missing, extra, *values), F.lit(""))


def errors(columns: list[str], codes: list[str], contract: dict = CONTRACT) -> Column:
    """All messages of a record, in order: missing and extra fields, each field's keywords, the calendar, the country.

    Fields are those of the data set, `columns`; where the AS_RECEIVED columns are among these, those of each record.
    """
    missing, extra, values = _messages(columns, codes, contract)
    return F.filter(F.concat(F.array(*missing).cast("array<string>"), extra, F.array(*values)), lambda m: m.isNotNull())


def reason(messages: Column) -> Column:
    return F.when(F.size(messages) > 0, F.array_join(messages, "; "))
