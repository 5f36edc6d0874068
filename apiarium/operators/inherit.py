"""Where documentation comes from: the member or type that a symbol inherits its text from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiarium.scratch import materialize


def natural_source(kind: Column, *, overridden: Column, explicit: Column, implicit: Column, base: Column) -> Column:
    """uid of a symbol's natural source by its kind; null where there is none.

    Methods, properties and events: what they override, else the first interface member that
    they name (array ``explicit``), else the one that they implement; types: their base.
    """
    member = F.coalesce(overridden, F.get(explicit, F.lit(0)), implicit)
    return F.when(kind.isin("Method", "Constructor", "Operator", "Property", "Event"), member).when(kind == "Type", base)


def implicit_implementation(members: DataFrame, interfaces: DataFrame, contracts: DataFrame, implements: DataFrame) -> DataFrame:
    """(uid, source): the first interface member that each member implements.

    members (uid, type); interfaces (type, ord, interface), all of a type in order; contracts
    (interface, ord, contract), the members of an interface in order; implements (type,
    contract, uid), what implements a contract in a type.
    """
    own = members.select("uid", "type").join(implements.select("type", "contract", "uid"), ["type", "uid"])
    ranked = own.join(contracts.select("interface", F.col("ord").alias("place"), "contract"), "contract")
    ranked = ranked.join(interfaces.select("type", "ord", "interface"), ["type", "interface"])
    return ranked.groupBy("uid").agg(F.min_by("contract", F.struct("ord", "place")).alias("source"))


def location_method(kind: Column, *, own: Column, getter: Column, setter: Column, adder: Column, remover: Column, first: Column) -> Column:
    """The method that stands for a symbol's place in the source.

    A method itself; a property's getter, else setter; an event's adder, else remover; of a
    field or a type the type's first method; null for anything else.
    """
    return (
        F.when(kind.isin("Method", "Constructor", "Operator"), own)
        .when(kind == "Property", F.coalesce(getter, setter))
        .when(kind == "Event", F.coalesce(adder, remover))
        .when(kind.isin("Field", "EnumValue", "Type"), first)
    )


def first_methods(members: DataFrame, *, owner: str, uid: str, is_method: Column, token: Column, order: str) -> DataFrame:
    """(owner, first): the first method of each type that has a token."""
    return members.filter(is_method & (token != 0)).groupBy(owner).agg(F.min_by(uid, order).alias("first"))


def resolve(nodes: DataFrame, *, fields: list[str]) -> DataFrame:
    """``uid``, the fields and ``inherited_from`` of each symbol after inheritance.

    nodes: uid, the fields (text, '' or null where empty), explicit (asks to inherit), cref
    (the source that it names, or null), natural (its natural source, or null) and container
    (shown as the source of what others inherit). A symbol that asks to inherit has its own
    fields and its source's where its own are empty; one without any text has its natural
    source's, and names it only if that has some; others keep their own. Symbols whose sources
    lead into a circle, or nowhere, keep their own and name none.

    Pointer jumping: each round doubles the distance that is resolved, so a chain of n takes
    log n joins; the rounds are bounded by the number of symbols.
    """
    own = [F.nullif(F.col(f), F.lit("")).alias(f) for f in fields]
    empty = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields]).isNull()
    source = F.when(F.col("explicit"), F.coalesce("cref", "natural")).when(empty, F.col("natural"))
    start = materialize(nodes.select("uid", *own, "explicit", "container", F.when(source != F.col("uid"), source).alias("source")), "inherit")
    known = start.select(F.col("uid").alias("source"), F.col("container").alias("from"))
    start = materialize(start.join(known, "source", "left").withColumn("source", F.when(F.col("from").isNotNull(), F.col("source"))), "inherit")
    state = start.select("uid", *fields, F.col("source").alias("ptr"))
    for _ in range(start.count().bit_length() + 1):
        up = state.select(F.col("uid").alias("ptr"), *[F.col(f).alias(f"up_{f}") for f in fields], F.col("ptr").alias("next"))
        state = materialize(state.join(up, "ptr", "left").select("uid", *[F.coalesce(f, f"up_{f}").alias(f) for f in fields], F.col("next").alias("ptr")), "inherit")
        if state.filter("ptr is not null").isEmpty():
            break
    done = state.select("uid", *[F.col(f).alias(f"all_{f}") for f in fields], F.col("ptr").isNull().alias("ends"))
    out = start.join(done, "uid")
    some = F.coalesce(*[F.col(f"all_{f}") for f in fields]).isNotNull()
    named = F.when(F.col("ends") & (F.col("explicit") | some), F.col("from"))
    return out.select("uid", *[F.when(F.col("ends"), F.col(f"all_{f}")).otherwise(F.col(f)).alias(f) for f in fields], named.alias("inherited_from"))
