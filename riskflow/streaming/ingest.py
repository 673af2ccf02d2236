"""Message validation (QLT10, LKG2) and the dead-letter split (SNK2).

A message's keys are listed, so that unknown and forbidden ones are seen, and its fields
are read as texts and cast one by one, so that the failing field is named.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import TOPIC_DEAD_LETTER, TOPIC_RAW
from riskflow.schema import COLUMNS, FORBIDDEN, ONLINE_COLUMNS, REQUEST_DEFAULTS, REQUIRED_REQUEST, TYPE_OF

# contract -> (fields that must be present, fields that may be present)
CONTRACTS: dict[str, tuple[list[str], list[str]]] = {
    "online": ([c for c in ONLINE_COLUMNS if c != "is_outlier"], ONLINE_COLUMNS),
    "training": ([c for c in COLUMNS if c != "is_outlier"], COLUMNS),
    "request": (REQUIRED_REQUEST, ONLINE_COLUMNS),
}


def _cast(text: Column, kind: str) -> Column:
    if kind in ("int", "bigint"):
        # A whole number may carry a zero fraction.
        return F.coalesce(text.try_cast(kind), F.regexp_replace(text, F.lit(r"\.0+$"), F.lit("")).try_cast(kind))
    return text.try_cast(kind)


def _names(columns: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])


def _broken(names: Sequence[str], test: Callable[[str], Column]) -> Column:
    """The names whose test is true."""
    return F.array_compact(F.array(*[F.when(test(n), F.lit(n)) for n in names]))


def validate_messages(raw: DataFrame, contract: str = "online", value: str = "value", with_defaults: bool = False) -> DataFrame:
    """Add the typed fields and ``error`` (the first failing rule, null when valid)."""
    required, allowed = CONTRACTS[contract]
    texts_schema = ", ".join(f"{c} string" for c in allowed)
    # Generating the one parsed value keeps filters on its fields above the parser;
    # pushed below it they would parse the text again for every field they mention.
    once = F.struct(F.json_object_keys(value).alias("keys"), F.from_json(F.col(value), texts_schema).alias("f"))
    parsed = raw.select("*", F.explode(F.array(once)).alias("_m"))
    keys = F.col("_m.keys")

    def text(name: str) -> Column:
        return F.col(f"_m.f.{name}")

    not_text = [c for c in allowed if TYPE_OF[c] != "string"]
    rules = {
        **({} if contract == "training" else {"forbidden_field": F.array_intersect(keys, _names(FORBIDDEN))}),
        "unknown_field": F.array_except(keys, _names(allowed)),
        "missing_field": _broken(required, lambda n: text(n).isNull()),
        "wrong_type": _broken(not_text, lambda n: text(n).isNotNull() & _cast(text(n), TYPE_OF[n]).isNull()),
    }
    found = F.array(*[F.concat(F.lit(f"{rule}: "), F.array_join(F.sort_array(bad), ",")) for rule, bad in rules.items()])
    first_broken = F.try_element_at(F.filter(found, lambda t: ~F.endswith(t, F.lit(": "))), F.lit(1))
    # Almost every message is clean, and seeing that takes comparisons only: each key is
    # one known field with a value, none is missing, and every cast succeeds.
    n_present = reduce(add, [text(n).isNotNull().cast("int") for n in allowed])
    complete = reduce(and_, [text(n).isNotNull() for n in required])
    typed_well = reduce(and_, [text(n).isNull() | _cast(text(n), TYPE_OF[n]).isNotNull() for n in not_text])
    clean = (F.size(keys) == n_present) & complete & typed_well
    error = F.when(keys.isNull(), F.lit("malformed_json")).when(~clean, first_broken)
    fields = []
    for name in allowed:
        typed = _cast(text(name), TYPE_OF[name])
        if name == "is_outlier" or (with_defaults and name in REQUEST_DEFAULTS):
            typed = F.coalesce(typed, F.lit(REQUEST_DEFAULTS[name]).cast(TYPE_OF[name]))
        fields.append(typed.alias(name))
    # The checked row is generated too: a filter on ``error`` then compares one column
    # instead of carrying the whole rule set into the optimizer's filter rules.
    checked = F.struct(*fields, error.alias("error"))
    return parsed.select(*raw.columns, F.explode(F.array(checked)).alias("_r")).select(*raw.columns, "_r.*")


def accepted(validated: DataFrame, columns: Sequence[str] = ONLINE_COLUMNS) -> DataFrame:
    return validated.where("error IS NULL").select(*columns)


def dead_letters(validated: DataFrame, key: str = "key", value: str = "value", topic: str = TOPIC_RAW) -> DataFrame:
    """Failed messages, wrapped with their origin and the reason."""
    body = F.to_json(F.struct(F.lit(topic).alias("original_topic"), "error", F.col(value).alias("data")))
    return validated.where("error IS NOT NULL").select(
        F.col(key).alias("key"), body.alias("value"), F.lit(TOPIC_DEAD_LETTER).alias("topic")
    )
