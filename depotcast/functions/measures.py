"""Stock measures: one conditional sum each, all taken in a single aggregation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from depotcast.config import PRODUCTS, StockLabels


def quoted(*values: str) -> str:
    """SQL string literals, comma-separated."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


@dataclass(frozen=True)
class Measure:
    name: str
    condition: str

    def total(self) -> Column:
        # a condition that is unknown (NULL operand) counts as not met
        return F.expr(f"sum(CASE WHEN {self.condition} THEN qty ELSE 0 END)").alias(self.name)


def stock_measures(labels: StockLabels) -> list[Measure]:
    """The 32 measures of a month-end stock position."""

    def status(value: str) -> str:
        return f"status_type = {quoted(value)}"

    def desc(*values: str) -> str:
        return f"status_desc IN ({quoted(*values)})"

    def by_class(stem: str, condition: str, column: str) -> list[Measure]:
        return [
            Measure(f"{stem}_{product}", f"{condition} AND {column} = {quoted(label)}")
            for product, label in zip(PRODUCTS, labels.classes)
        ]

    rented, ready, sale = status(labels.rented), status(labels.ready), status(labels.sale)
    unavailable = status(labels.unavailable)
    operational = f"operational_flag = {quoted(labels.operational)}"
    maintenance = desc(labels.in_maintenance)
    elsewhere = (
        labels.in_maintenance, labels.in_transit_new, labels.received_new, labels.between_branches,
    )
    accounted = (*elsewhere, labels.collected, labels.misappropriated, labels.impounded)
    return [
        Measure("rented_total", rented),
        *by_class("rented", rented, "product_rented"),
        Measure("operational_total", operational),
        *by_class("operational", f"{operational} AND NOT {rented}", "product_class"),
        Measure("ready_total", ready),
        *by_class("ready", ready, "product_class"),
        Measure("maintenance_total", maintenance),
        *by_class("maintenance", maintenance, "product_class"),
        Measure("transit_new_by_desc", desc(labels.in_transit_new)),
        Measure("factory_new", status(labels.factory_new)),
        Measure("administrative", status(labels.administrative)),
        Measure("sale_total", sale),
        Measure("sale_own_programme", f"{sale} AND {desc(*labels.own_programme)}"),
        Measure(
            "sale_direct_or_donation",
            f"{sale} AND NOT {desc(*labels.own_programme, labels.awaiting_auction)}",
        ),
        Measure("sale_awaiting_auction", f"{sale} AND {desc(labels.awaiting_auction)}"),
        Measure("total_loss", status(labels.total_loss)),
        Measure("stolen", status(labels.stolen)),
        Measure(
            "unavailable_between_branches",
            f"{unavailable} AND {desc(labels.between_branches, labels.collected)}",
        ),
        Measure("unavailable_general", f"{unavailable} AND NOT {desc(*elsewhere)}"),
        Measure("unavailable_impounded", f"{unavailable} AND {desc(labels.impounded)}"),
        Measure("unavailable_misappropriated", f"{unavailable} AND {desc(labels.misappropriated)}"),
        Measure("unavailable_regulatory", f"{unavailable} AND NOT {desc(*accounted)}"),
        Measure("received_new", desc(labels.received_new)),
        Measure("transit_new_by_type", status(labels.transit_new)),
    ]


# the 20 measures of the monthly flow-sum, a subset of the list above
FLOW_MEASURES = (
    "rented_total", "operational_total", "ready_total", "maintenance_total",
    "rented_new", "rented_semi", "rented_used",
    "operational_new", "operational_semi", "operational_used",
    "ready_new", "ready_semi", "ready_used",
    "sale_total", "sale_own_programme", "total_loss", "stolen", "unavailable_misappropriated",
    "received_new", "transit_new_by_type",
)


def measures_named(labels: StockLabels, names: Iterable[str]) -> list[Measure]:
    by_name = {m.name: m for m in stock_measures(labels)}
    return [by_name[name] for name in names]
