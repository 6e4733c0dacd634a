"""Extraction responses: tolerant parsing and field validation over VARIANT (K1 to K3, K6, §1.3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import let, strip

# The domains of enumerated fields and the lengths of cut ones.
OWNERS, PRIORITIES, TODO_STATES = ("me", "partner", "unknown"), ("high", "medium", "low"), ("new", "in_progress", "waiting", "done", "cancelled")
ENTITY_TYPES = ("Person", "Organization", "Location", "PhoneNumber", "Product", "Project", "Event", "Contract", "Other")
ROLES = ("customer", "supplier", "employee", "carrier", "unknown")
CATEGORIES = ("환풍기", "송풍기", "케이스", "날개", "채반", "부품", "기타", "unknown")
ACTIONS = ("quote", "order", "deliver", "repair", "check_stock", "manufacture", "unknown")
MONEY_KINDS, PAYMENT_STATES = ("price", "deposit", "balance", "shipping", "discount", "tax", "unknown"), ("paid", "unpaid", "partial", "unknown")
RISK_TYPES = ("missed_deadline", "payment_delay", "customer_complaint", "stock_shortage", "quality_issue", "privacy", "ambiguous_request", "other")
REASONS = ("exact_rule", "alias", "contextual", "spacing", "number_normalization", "other")


def cleaned(response: Column) -> Column:
    """Without the lines of a code fence, if it begins with one."""
    bare = strip(response)
    lines = F.array_join(F.filter(F.split(bare, "\n"), lambda x: ~strip(x).startswith("```")), "\n")
    return F.when(bare.startswith("```"), lines).otherwise(bare)


def parsed(response: Column) -> Column:
    """The response as a VARIANT object: whole, else from its first brace to its last; null if neither is JSON."""
    c = cleaned(response)
    outer = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(outer, F.lit(""))))


def client_object(response: Column) -> Column:
    """As a client reads a response: a fence's beginning and end go, not its lines; the whole, else from the first brace to the last,
    as VARIANT; null if neither is JSON."""
    bare = strip(F.coalesce(response, F.lit("")))
    # One mark with `json`, and then one without; behind them one at the end.
    inner = strip(F.regexp_replace(F.regexp_replace(bare, "\\A(?:```json)?(?:```)?", ""), "```\\z", ""))
    text = F.when(bare.startswith("```"), inner).otherwise(bare)
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(F.nullif(text, F.lit(""))), F.try_parse_json(F.nullif(outer, F.lit(""))))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column) -> Column:
    """As Python's str() has it for scalars: None, True, False."""
    s = F.try_variant_get(v, "$", "string")
    return F.when(F.is_variant_null(v), "None").when(_kind(v) == "BOOLEAN", F.initcap(s)).otherwise(s)


def _true(v: Column) -> Column:
    """Present, and neither null, empty, zero nor false."""
    s = F.try_variant_get(v, "$", "string")
    kind = _kind(v)
    no = F.is_variant_null(v) | (s == "") | ((kind == "BOOLEAN") & (s == "false")) | s.isin("[]", "{}") | (~kind.isin("STRING", "BOOLEAN") & (F.try_variant_get(v, "$", "double") == 0))
    return v.isNotNull() & ~F.coalesce(no, F.lit(False))


def _text(item: Column, name: str, default: str | None = "", most: int | None = None) -> Column:
    v = _get(item, name)
    s = F.when(v.isNull(), F.lit(default)).otherwise(_string(v))
    return s if most is None else F.substring(s, 1, most)


def _maybe(item: Column, name: str) -> Column:
    v = _get(item, name)
    return F.when(_true(v), _string(v))


def _one_of(item: Column, name: str, domain: Sequence[str], default: str) -> Column:
    v = F.try_variant_get(item, f"$.{name}", "string")
    return F.when(v.isin(*domain) & (_kind(_get(item, name)) == "STRING"), v).otherwise(F.lit(default))


def _number(item: Column, name: str, default: float) -> Column:
    """A double; null where the field is there but no number."""
    v = _get(item, name)
    return F.when(v.isNull(), F.lit(default)).otherwise(F.try_variant_get(v, "$", "double"))


def _whole(item: Column, name: str) -> Column:
    """Cut to an integer; null where the field is there but no number. A string counts only if it is a whole number."""
    v = _get(item, name)
    as_number = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string").try_cast("bigint")).otherwise(F.try_variant_get(v, "$", "double").try_cast("bigint"))
    return F.when(v.isNull(), F.lit(0)).otherwise(as_number).cast("bigint")


def _list(item: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _strings(item: Column, name: str, many: int, most: int | None = None) -> Column:
    s = F.transform(F.filter(_list(item, name), _true), _string)
    s = s if most is None else F.transform(s, lambda x: F.substring(x, 1, most))
    return F.slice(s, 1, many)


def _each(doc: Column, name: str, required: Sequence[str], fields) -> Column:
    def good(x: Column) -> Column:
        ok = _is_object(x)
        for r in required:
            ok = ok & _true(_get(x, r))
        return ok

    return F.transform(F.filter(_list(doc, name), good), lambda x: F.struct(*[c.alias(k) for k, c in fields(x).items()]))


def _quoted(x: Column) -> dict[str, Column]:
    return {"source_quote": _text(x, "source_quote", most=300), "confidence": _number(x, "confidence", 0.5)}


def todos(doc: Column) -> Column:
    return _each(doc, "todos", ["title"], lambda x: {
        "id_hint": _text(x, "id_hint", most=50), "title": strip(_text(x, "title")), "owner": _one_of(x, "owner", OWNERS, "unknown"),
        "priority": _one_of(x, "priority", PRIORITIES, "medium"), "status": _one_of(x, "status", TODO_STATES, "new"),
        "due_date": _maybe(x, "due_date"), "due_time": _maybe(x, "due_time"), "context": _text(x, "context", most=200), **_quoted(x),
    })


def appointments(doc: Column) -> Column:
    return _each(doc, "appointments", ["title"], lambda x: {
        "title": strip(_text(x, "title")), "date": _maybe(x, "date"), "time": _maybe(x, "time"), "timezone": _text(x, "timezone", "Asia/Seoul"),
        "location": _maybe(x, "location"), "participants": _strings(x, "participants", 10), "description": _text(x, "description", most=200), **_quoted(x),
    })


def entities(doc: Column) -> Column:
    return _each(doc, "entities", ["name"], lambda x: {
        "name": strip(_text(x, "name")), "type": _one_of(x, "type", ENTITY_TYPES, "Other"), "canonical_name": _maybe(x, "canonical_name"),
        "role": _one_of(x, "role", ROLES, "unknown"), "attributes": F.when(_is_object(_get(x, "attributes")), F.to_json(_get(x, "attributes"))).otherwise("{}"), **_quoted(x),
    })


def products(doc: Column) -> Column:
    def fields(x: Column) -> dict[str, Column]:
        q = _get(x, "quantity")
        q = F.when(_is_object(q), q)
        return {
            "name": strip(_text(x, "name")), "canonical_name": _maybe(x, "canonical_name"), "category": _one_of(x, "category", CATEGORIES, "unknown"), "spec": _maybe(x, "spec"),
            "quantity": F.struct(_whole(q, "value").alias("value"), _text(q, "unit", "unknown").alias("unit")), "action": _one_of(x, "action", ACTIONS, "unknown"), **_quoted(x),
        }

    return _each(doc, "products", ["name"], fields)


def money(doc: Column) -> Column:
    return _each(doc, "money", [], lambda x: {
        "amount": F.coalesce(_whole(x, "amount"), F.lit(0).cast("bigint")), "currency": _text(x, "currency", "KRW"), "kind": _one_of(x, "kind", MONEY_KINDS, "unknown"),
        "related_to": _maybe(x, "related_to"), "payment_status": _one_of(x, "payment_status", PAYMENT_STATES, "unknown"), "due_date": _maybe(x, "due_date"), **_quoted(x),
    })


def risks(doc: Column) -> Column:
    return _each(doc, "risks", ["description"], lambda x: {
        "severity": _one_of(x, "severity", PRIORITIES, "medium"), "type": _one_of(x, "type", RISK_TYPES, "other"), "description": _text(x, "description", most=300),
        "recommended_action": _maybe(x, "recommended_action"), **_quoted(x),
    })


def corrections(doc: Column) -> Column:
    return _each(doc, "corrections", ["original", "corrected"], lambda x: {
        "original": _text(x, "original", most=200), "corrected": _text(x, "corrected", most=200), "rule_id": _maybe(x, "rule_id"), "reason": _one_of(x, "reason", REASONS, "other"), **_quoted(x),
    })


def summary(doc: Column) -> Column:
    s = _get(doc, "summary")
    return F.when(_is_object(s), F.struct(
        _text(s, "one_line", most=300).alias("one_line"), _strings(s, "details", 5, 200).alias("details"),
        _text(s, "call_type", "unknown").alias("call_type"), _number(s, "overall_confidence", 0.0).alias("overall_confidence"),
    ))


LISTS = {"todos": todos, "appointments": appointments, "entities": entities, "products": products, "money": money, "risks": risks, "corrections": corrections}


def extraction_record(response: Column) -> Column:
    """The validated record of a response. invalid_number: a field that must be a number is none, and the whole document goes
    to the fallback; parse_error: there is no JSON in the response, of which `raw` has the first 500 characters."""
    def read(doc: Column) -> Column:
        return F.struct(summary(doc).alias("summary"), *[f(doc).alias(k) for k, f in LISTS.items()], doc.isNull().alias("parse_error"))

    def checked(r: Column) -> Column:
        bad = r["summary"].isNotNull() & r["summary"]["overall_confidence"].isNull()
        for k in LISTS:
            bad = bad | F.exists(r[k], lambda x: x["confidence"].isNull())
        bad = bad | F.exists(r["products"], lambda x: x["quantity"]["value"].isNull())
        return F.struct(
            *[r[k].alias(k) for k in ("summary", *LISTS, "parse_error")],
            F.when(r["parse_error"], F.substring(cleaned(response), 1, 500)).alias("raw"),
            F.coalesce(bad, F.lit(False)).alias("invalid_number"),
        )

    return let(let(parsed(response), read), checked)


def two_lists(response: Column, first: str, second: str) -> Column:
    """Struct of two lists of a response as they are, unvalidated, and parse_error."""
    return let(parsed(response), lambda doc: F.struct(_list(doc, first).alias(first), _list(doc, second).alias(second), doc.isNull().alias("parse_error")))
