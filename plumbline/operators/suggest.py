"""Suggesting checks from a profile.

Columns get roles by name, type and cardinality.  The roles of a table form an
entry that the user may complete (foreign keys, rules, limits), and an entry
gives a list of checks.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.plans.measure import local_frame
from plumbline.spec import CheckSpec

# Parts of names that tell the role of a column.
_MONEY_WORDS = (
    "price", "cost", "amount", "revenue", "fee", "tax", "discount",
    "paid", "profit", "wage", "salary", "charge", "spend", "budget",
)
_TIME_WORDS = (
    "_at", "_date", "_time", "_ts", "_timestamp",
    "created", "updated", "modified", "loaded", "processed", "ingested",
)
_NUMBER_WORDS = _MONEY_WORDS + (
    "qty", "quantity", "count", "cnt", "num", "nbr", "total",
    "rate", "ratio", "pct", "percent", "score", "weight", "size",
    "width", "height", "length", "age", "year", "month", "day",
    "hour", "minute", "second", "bound",
)
_KEY_SUFFIX = "(_sk|_key|_pk)$"
_ID_SUFFIX = "(_id|_code|_num|_no|_nbr)$"
_CURRENCY_WORDS = ("currency", "curr_cd", "ccy")

# Limits of a categorical column.
_FEW_VALUES = 50
_FEW_VALUES_SHARE = 0.02


def _contains_any(name: Column, words: Iterable[str]) -> Column:
    return name.rlike("|".join(words))


def column_roles(profiled: DataFrame) -> DataFrame:
    """One row per column: its roles, value domain, range and currency column."""
    name, category = F.lower("column"), F.col("category")
    number_type = category.isin("int", "float")
    untyped = category == "str"
    numeric = number_type | (untyped & _contains_any(name, _NUMBER_WORDS))
    key = name.rlike(_KEY_SUFFIX) & (number_type | untyped)
    business = ~key & name.rlike(_ID_SUFFIX) & ~numeric
    money = numeric & _contains_any(name, _MONEY_WORDS)
    time = (category == "datetime") | (_contains_any(name, _TIME_WORDS) & ~key)
    values = F.coalesce("unique_count", F.lit(0))
    few = (values > 0) & (
        (values <= _FEW_VALUES) | (values / F.greatest("row_count", F.lit(1)) <= _FEW_VALUES_SHARE)
    )
    found = {
        "pk": key,
        "bk": business,
        "monetary": money,
        "timestamp": time,
        "categorical": ~numeric & ~key & ~business & ~time & few,
        "numeric": numeric & ~money & ~key,
    }
    names = F.array(*[F.when(cond, F.lit(role)) for role, cond in found.items()])
    number = lambda c: F.when(category.isin("int", "float"), F.col(c).try_cast("double"))
    # One row per column of a table in each window.
    of_table = Window.partitionBy("table").orderBy("ordinal").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    currency = F.first(F.when(_contains_any(name, _CURRENCY_WORDS), F.col("column")), ignorenulls=True).over(of_table)
    most_frequent = F.transform(
        F.map_entries("top_values"), lambda v: F.struct((-v["value"]).alias("order"), v["key"].alias("key"))
    )
    return profiled.select(
        "table", "ordinal", "column",
        F.array_compact(names).alias("roles"),
        # A domain that lacks values would make a check of all the values it lacks.
        F.when(F.size("top_values") == F.col("unique_count"), F.transform(F.array_sort(most_frequent), lambda v: v["key"]))
        .alias("valid_values"),
        number("min_value").alias("min"), number("max_value").alias("max"),
        currency.alias("currency_column"),
    )


def table_entries(roles: DataFrame, references: DataFrame | None = None) -> list[dict[str, Any]]:
    """The entry of each table, to be completed by hand.

    Collects one row per column.  The empty fields are for what a profile cannot
    know: rules, limits of freshness and volume.  ``references`` are foreign keys found in the data
    (``discover.foreign_keys``), one row each.
    """
    entries: dict[str, dict[str, Any]] = {}
    for r in roles.orderBy("table", "ordinal").collect():
        entry = entries.setdefault(r["table"], {
            "name": r["table"], "ai_role": "unknown", "id_columns": [], "monetary_columns": [],
            "categorical_columns": [], "numeric_columns": [], "timestamp_columns": [],
            "foreign_keys": [], "business_rules": [], "conditional_completeness": [],
            "volume": {"max_daily_change_pct": 30, "prior_table": None},
        })
        column = {"column": r["column"]}
        for role in r["roles"]:
            if role == "pk":
                entry["id_columns"].append(column | {"is_primary_key": True})
            elif role == "bk":
                entry["id_columns"].append(column | {"is_business_key": True})
            elif role == "monetary":
                entry["monetary_columns"].append(column | {
                    "must_be_positive": True, "currency_column": r["currency_column"], "valid_currencies": [],
                })
            elif role == "categorical":
                entry["categorical_columns"].append(column | {
                    "valid_values": r["valid_values"] or None, "standardize": False,
                })
            elif role == "timestamp":
                entry["timestamp_columns"].append(column | {
                    "freshness_sla_hours": None, "is_event_time": False,
                    "late_arrival_hours": None, "must_be_after": None,
                })
            else:
                entry["numeric_columns"].append(column | {
                    "min": r["min"], "max": r["max"], "must_be_positive": False,
                })
    for r in references.orderBy("child_table", "child_column", "parent_table", "parent_column").collect() if references is not None else ():
        if r["child_table"] in entries:
            entries[r["child_table"]]["foreign_keys"].append({
                "column": r["child_column"], "references_table": r["parent_table"], "references_column": r["parent_column"],
            })
    return list(entries.values())


def suggest_checks(entries: Iterable[Mapping[str, Any]]) -> list[CheckSpec]:
    """The checks that follow from the entries of tables."""
    return [spec for entry in entries for rules in (_from_roles, _from_answers) for spec in rules(_Entry(entry))]


class _Entry:
    """An entry with its lists by role, all present."""

    def __init__(self, raw: Mapping[str, Any]) -> None:
        self.table: str = raw["name"]
        self._raw = raw
        self.ids, self.money = self.list("id_columns"), self.list("monetary_columns")
        self.labels, self.numbers = self.list("categorical_columns"), self.list("numeric_columns")
        self.times = self.list("timestamp_columns")

    def list(self, field: str) -> list[Any]:
        return list(self._raw.get(field) or [])

    @property
    def volume(self) -> Mapping[str, Any]:
        return self._raw.get("volume") or {}

    def check(self, check_id: int, column: str | None = None, **parameters: Any) -> CheckSpec:
        return CheckSpec.from_dict({"check_id": check_id, "table": self.table, "column": column, **parameters})

    def each(self, check_id: int, columns: Iterable[Mapping[str, Any]], **parameters: Any) -> list[CheckSpec]:
        return [self.check(check_id, c["column"], **parameters) for c in columns]


def _from_roles(e: _Entry) -> Iterator[CheckSpec]:
    """Checks that the roles alone justify."""
    keys = [c for c in e.ids if c.get("is_primary_key")]
    other_ids = [c for c in e.ids if not c.get("is_primary_key")]
    business = [c["column"] for c in e.ids if c.get("is_business_key")]
    critical = [c["column"] for c in e.money + e.ids]

    yield from e.each(1, e.money + e.labels + e.numbers + e.times + other_ids)
    if len(critical) > 1:
        yield e.check(2, columns=critical)
    if critical:
        yield e.check(3, columns=critical)
    for c in keys:
        yield e.check(5, pk_column=c["column"])
    if business:
        yield e.check(6, business_key_columns=business)
        yield e.check(7, columns=business)
    yield from e.each(8, e.money, extra={"expected_type": "DOUBLE"})
    yield from e.each(12, [c for c in e.money if c.get("must_be_positive", True)])
    yield from e.each(12, [c for c in e.numbers if c.get("must_be_positive")])
    links = e.list("foreign_keys")
    for check_id in (17, 18):
        for fk in links:
            yield CheckSpec(
                check_id, child_table=e.table, child_column=fk["column"],
                parent_table=fk["references_table"], parent_column=fk["references_column"],
            )
    for fk in links:
        yield CheckSpec(
            19, source_table=e.table, source_column=fk["column"],
            reference_table=fk["references_table"], reference_column=fk["references_column"],
        )
    yield from e.each(28, e.numbers + e.money)
    yield from e.each(29, e.numbers)


def _from_answers(e: _Entry) -> Iterator[CheckSpec]:
    """Checks that need a value domain, a limit or a rule."""
    for c in e.labels:
        if c.get("valid_values"):
            yield e.check(9, c["column"], allowed_values=c["valid_values"])
    for c in e.numbers:
        if c.get("min") is not None or c.get("max") is not None:
            yield e.check(11, c["column"], min_value=c.get("min"), max_value=c.get("max"))
    for c in e.money:
        if c.get("currency_column") and c.get("valid_currencies"):
            yield e.check(15, c["currency_column"], allowed_values=c["valid_currencies"])
    for c in e.labels:
        if c.get("standardize") and c.get("valid_values"):
            yield e.check(16, c["column"], allowed_values=c["valid_values"])
    timed = [c for c in e.times if c.get("freshness_sla_hours") is not None]
    for c in timed:
        yield e.check(20, timestamp_column=c["column"], freshness_sla_hours=c["freshness_sla_hours"])
    for c in timed:
        yield e.check(21, timestamp_column=c["column"], stale_days=round(c["freshness_sla_hours"] / 24, 1))
    for c in e.times:
        loads = [o["column"] for o in e.times if o["column"] != c["column"]]
        if c.get("is_event_time") and c.get("late_arrival_hours") and loads:
            yield e.check(
                22, event_timestamp_column=c["column"], load_timestamp_column=loads[0],
                late_arrival_hours=c["late_arrival_hours"],
            )
    for c in e.times:
        if c.get("must_be_after"):
            yield e.check(13, condition=f"{c['column']} < {c['must_be_after']}")
    for rule in e.list("conditional_completeness"):
        if rule.get("condition") and rule.get("column_must_not_be_null"):
            yield e.check(4, condition=rule["condition"], dependent_column=rule["column_must_not_be_null"])
    for rule in e.list("business_rules"):
        if isinstance(rule, str) and rule.strip():
            yield e.check(26, condition=rule)
    yield from _volume(e)


def _volume(e: _Entry) -> Iterator[CheckSpec]:
    change = e.volume.get("max_daily_change_pct")
    if change is None:
        return
    band = {"today_table": e.table, "volume_change_band": change / 100.0}
    if e.volume.get("prior_table"):
        yield CheckSpec(23, prior_table=e.volume["prior_table"], **band)
    elif e.volume.get("is_date_partitioned") and e.volume.get("partition_column"):
        yield CheckSpec(23, condition=f"{e.volume['partition_column']} = current_date()", **band)


# -- from declared keys -------------------------------------------------------

# Parts of names of amounts that must not be negative.
_AMOUNT_WORDS = ("price", "cost", "amt", "amount", "paid", "quantity")


def checks_from_constraints(
    columns: Iterable[tuple[str, str, str]],
    primary_keys: Mapping[str, Iterable[str]],
    foreign_keys: Iterable[tuple[str, str, str, str]] = (),
    per_check: Mapping[int, int] | None = None,
) -> list[CheckSpec]:
    """Checks from a schema, for all columns they apply to or as many as ``per_check`` says by check: (table, column, type) rows, primary keys by table, and
    foreign keys as (table, column, parent table, parent column)."""
    by_table: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for table, column, kind in columns:
        by_table[table].append((column, kind.lower()))
    links: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for table, *link in foreign_keys:
        links[table].append(tuple(link))
    specs, most = [], dict(per_check or {})
    for table, listed in by_table.items():
        plain = [c for c, _ in listed if not c.endswith("_sk")]
        ids = [c for c, kind in listed if c.endswith("_id") and kind in ("string", "varchar")]
        amounts = [c for c, _ in listed if any(w in c for w in _AMOUNT_WORDS)]
        specs += [CheckSpec(1, table=table, column=c) for c in plain[: most.get(1)]]
        specs += [CheckSpec(5, table=table, pk_column=c) for c in primary_keys.get(table, ())]
        specs += [CheckSpec(6, table=table, business_key_columns=(c,)) for c in ids[: most.get(6)]]
        specs += [CheckSpec(12, table=table, column=c) for c in amounts[: most.get(12)]]
        specs += [
            CheckSpec(17, child_table=table, child_column=c, parent_table=p, parent_column=pc)
            for c, p, pc in links[table]
        ]
    return specs


def specs_frame(spark: SparkSession, specs: Iterable[CheckSpec]) -> DataFrame:
    """Specs as rows: number, check, table, columns, and all parameters as JSON."""
    specs = list(specs)
    return local_frame(spark, {
        "seq": (range(len(specs)), pa.int32()),
        "check_id": ([s.check_id for s in specs], pa.int32()),
        "table": ([s.table_label for s in specs], pa.string()),
        "column": ([s.column_label for s in specs], pa.string()),
        "parameters": ([json.dumps(s.to_dict(), sort_keys=True, default=str) for s in specs], pa.string()),
    })
