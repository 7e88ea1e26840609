"""Indicators kept up by what changed, not by a window of days.

A silver table's merge drops folders and writes others. The rows of the dropped ones
count minus, those of the new ones plus: what an upsert has replaced leaves its old
group, what it has written joins its new one, and rows that were only carried along
cancel out. The signed sums are added to a state table with the exact sums of each
group; a group without rows vanishes. An indicator that counts distinct values keeps its
state a value, so that a value goes when its last row goes. Gold is then computed anew
for the groups that the change touches.

The state's commit holds the silver version that it contains, the gold commit the one
it was made from. A run that stops between both is made good by the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.exprs import ratio
from finlake.sources.store import TableStore

c = F.col
_MONEY = "decimal(38,8)"


@dataclass(frozen=True)
class Indicator:
    """groups: name -> column of a source row; sums: name -> what is added up, its non-null
    values counted as well; finish: the measures from a group's rows and sums."""

    source: str
    groups: Callable[[], dict[str, Column]]
    sums: Callable[[], dict[str, Column]]
    finish: Callable[[], dict[str, Column]]
    distinct: str | None = None
    #: rows of the source to the rows that are counted
    rows: Callable[[DataFrame], DataFrame] = lambda df: df


def total(name: str) -> Column:
    """A sum, null where no value was there."""
    return F.when(c(f"{name}_n") > 0, F.round(c(f"{name}_sum").cast("double"), 2))


def mean(name: str) -> Column:
    return F.round(F.try_divide(c(f"{name}_sum").cast("double"), c(f"{name}_n")), 2)


def trues(name: str) -> Column:
    return F.when(c(f"{name}_n") > 0, c(f"{name}_sum").cast("long"))


def _failures(ok: str) -> Column:
    return ratio((c("n") - trues(ok)) * 100.0, c("n"), 2)


def _flag(name: str) -> Column:
    return c(name).cast("int")


def _sides(rows: DataFrame) -> DataFrame:
    """Each transfer for its sender's and its receiver's country."""
    sides = F.array(*[F.struct(c(f"{who}_country").alias("_country"), F.lit(way).alias("_way")) for who, way in (("sender", "SORTANT"), ("receiver", "ENTRANT"))])
    return rows.where("est_transfrontalier").withColumn("_side", F.explode(sides))


INDICATORS = {
    "daily_transaction_volume": Indicator(
        "bank_transactions", lambda: {k: c(k) for k in ("country_code", "transaction_date", "entity_type", "transaction_type")},
        lambda: {"ok": _flag("est_aboutie"), "eur": c("amount_eur"), "fees": c("fee_amount_eur"), "aml": _flag("depasse_seuil_aml")},
        lambda: {
            "nb_transactions": c("n"), "nb_abouties": trues("ok"), "montant_total_eur": total("eur"), "montant_moyen_eur": mean("eur"), "commissions_eur": total("fees"),
            "nb_au_dessus_seuil_aml": trues("aml"), "taux_echec": _failures("ok"),
        },
    ),
    "mobile_money_daily_flow": Indicator(
        "mobile_money_payments", lambda: {k: c(k) for k in ("country_code", "payment_date")},
        lambda: {"ok": _flag("est_aboutie"), "eur": c("amount_eur"), "fees": c("fee_amount_eur"), "far": _flag("est_transfrontalier")},
        lambda: {
            "nb_paiements": c("n"), "nb_abouties": trues("ok"), "montant_total_eur": total("eur"), "commissions_eur": total("fees"), "utilisateurs_actifs": c("distinct"),
            "nb_transfrontaliers": trues("far"), "taux_echec": _failures("ok"),
        }, "sender_id",
    ),
    "cross_border_transfers": Indicator(
        "mobile_money_payments",
        lambda: {"country_code": c("_side._country"), "corridor": c("corridor"), "sens": c("_side._way"), "semaine": F.date_trunc("week", "payment_date").cast("date")},
        lambda: {"eur": c("amount_eur")}, lambda: {"nb_transferts": c("n"), "montant_total_eur": total("eur"), "montant_moyen_eur": mean("eur")}, None, _sides,
    ),
}


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [c(a).eqNullSafe(c(b)) for a, b in zip(left, right)])


def signed(indicator: Indicator, changes: DataFrame) -> DataFrame:
    """Sums of the changes by group (and counted value); what cancels out is left out."""
    sums, groups = indicator.sums(), indicator.groups()
    value = {"_value": c(indicator.distinct)} if indicator.distinct else {}
    rows = indicator.rows(changes).select(*[e.alias(k) for k, e in (groups | value).items()], "_sign", *[e.alias(f"_{k}") for k, e in sums.items()])
    added = [F.sum("_sign").alias("n")]
    for k in sums:
        added.append(F.coalesce(F.sum(c(f"_{k}").cast("decimal(24,8)") * c("_sign")), F.lit(0)).cast(_MONEY).alias(f"{k}_sum"))
        added.append(F.coalesce(F.sum(F.when(c(f"_{k}").isNotNull(), c("_sign"))), F.lit(0)).alias(f"{k}_n"))
    moved = reduce(lambda a, b: a | b, [c(n) != 0 for k in sums for n in (f"{k}_sum", f"{k}_n")], c("n") != 0)
    return rows.groupBy(*groups, *value).agg(*added).where(moved)


def _added(indicator: Indicator, parts: DataFrame) -> DataFrame:
    """State rows of equal groups added up."""
    keys = [*indicator.groups(), *(["_value"] if indicator.distinct else [])]
    sums = [n for k in indicator.sums() for n in (f"{k}_sum", f"{k}_n")]
    return parts.groupBy(*keys).agg(*[F.sum(n).cast(_MONEY if n.endswith("_sum") else "long").alias(n) for n in ("n", *sums)])


def finished(indicator: Indicator, state: DataFrame) -> DataFrame:
    """Gold rows from state rows."""
    keys, sums = list(indicator.groups()), [n for k in indicator.sums() for n in (f"{k}_sum", f"{k}_n")]
    if indicator.distinct:
        state = state.groupBy(*keys).agg(F.count("_value").alias("distinct"), *[F.sum(n).alias(n) for n in ("n", *sums)])
    return state.select(*keys, *[e.alias(k) for k, e in indicator.finish().items()])


@contextmanager
def _draft(store: TableStore, df: DataFrame):
    """df written beside the tables and read from there, for as long as it is needed."""
    path = f"{store.root}/_drafts/{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        jvm, fs = store._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("processed_at", F.current_timestamp())


def maintain(store: TableStore, name: str, indicator: Indicator | None = None, zone: str = "silver") -> dict:
    """Bring an indicator up to its source's current version: {mode: none, delta or full, groups}."""
    indicator = indicator or INDICATORS[name]
    keys = list(indicator.groups())
    by = [k for k in keys if k == "country_code"]
    upto = store.current(zone, indicator.source)["version"]
    states, golds = store.current("state", name), store.current("gold", name)
    since = states["note"].get("upto") if states else None
    changes = store.changes(zone, indicator.source, since) if since and since != upto else None
    if since is None or (since != upto and changes is None):
        everything = store.changes(zone, indicator.source, 0)
        store.overwrite("state", name, signed(indicator, everything), by, note={"upto": upto})
    elif since == upto and golds and golds["note"].get("upto") == upto:
        return {"mode": "none", "groups": 0}
    elif changes is not None and golds and golds["note"].get("upto") == since:
        with _draft(store, signed(indicator, changes)) as delta:
            own = [*keys, *(["_value"] if indicator.distinct else [])]
            renamed = delta.select(*[c(k).alias(f"_k_{k}") for k in own])
            before = store.read("state", name)
            before = before.join(renamed, _same(own, [f"_k_{k}" for k in own]), "left_semi")
            now = _added(indicator, before.unionByName(delta)).withColumn("_gone", c("n") == 0)
            store.merge("state", name, now, own, by, removed="_gone", unique=True, note={"upto": upto})
            touched = delta.select(*[c(k).alias(f"_k_{k}") for k in keys]).distinct()
            match = _same(keys, [f"_k_{k}" for k in keys])
            rows = finished(indicator, store.read("state", name).join(touched, match, "left_semi")).withColumn("_there", F.lit(True))
            gone = c("_there").isNull()
            out = touched.join(rows, match, "left").select(
                *[c(f"_k_{k}").alias(k) for k in keys], *indicator.finish(), gone.alias("_gone"),
            )
            store.merge("gold", name, _stamped(out), keys, by, removed="_gone", unique=True, note={"upto": upto})
            return {"mode": "delta", "groups": touched.count()}
    elif since != upto:  # gold is behind its state: the state first, then all of gold
        with _draft(store, signed(indicator, changes)) as delta:
            now = _added(indicator, store.read("state", name).unionByName(delta)).where("n <> 0")
            store.overwrite("state", name, now, by, note={"upto": upto})
    done = store.overwrite("gold", name, _stamped(finished(indicator, store.read("state", name))), by, note={"upto": upto})
    return {"mode": "full", "groups": done["rows"]}


def run(store: TableStore, names=None) -> dict[str, dict]:
    """All indicators that add up; each reads its source's changed folders alone."""
    return {name: maintain(store, name) for name in names or INDICATORS}
