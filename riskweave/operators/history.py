"""History of changing entity attributes.

Snapshots of an entity become versions: a per-entity sorted struct array is
folded by a higher-order function that appends a version only upon a change of
a known value, and the versions are exploded with their end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.addresses import QUARTER_WORDS, address_parts
from riskweave.functions.documents import known_document

OPEN_END = 999912


def month_before(yyyymm: Column) -> Column:
    return F.when(yyyymm % 100 == 1, yyyymm - 89).otherwise(yyyymm - 1)


def latest_load(df: DataFrame, key: Sequence[str], load: str, values: Sequence[str]) -> DataFrame:
    """One row per key: of its loads the one with the greatest ``load``.

    Equal loads count as copies; should they differ, the greatest values in
    column order win, so the result does not depend on row order. The values
    are compared as one struct in a partial aggregate, so a key loaded very
    often collapses before the shuffle. A null load counts as the earliest.
    """
    top = F.max(F.struct(F.col(load).alias("_l"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])).alias("_t")
    return df.groupBy(*key).agg(top).select(*key, *[F.col(f"_t._v{i}").alias(v) for i, v in enumerate(values)])


def fold_versions(
    df: DataFrame,
    entity: str,
    period: str,
    attributes: Sequence[str],
    same: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """Versions of each entity: entity, ``valid_from``, ``valid_to``, attributes.

    ``df`` holds at most one row per (entity, period); a null attribute means
    "not informed". An entity's first row always opens a version. ``same`` gives
    an equality per attribute (default: plain equality). ``valid_to`` is the
    month before the next version, or ``OPEN_END``. A null entity is skipped.
    Return to former values opens a new version; gaps change nothing. An
    attribute first informed later than the first row fills the version at hand.
    The array of an entity is as long as its number of periods, not of rows.
    """
    same = same or {}
    item = F.struct(F.col(period).alias("at"), *[F.col(a).alias(a) for a in attributes])
    rows = df.where(F.col(entity).isNotNull() & F.col(period).isNotNull()).groupBy(entity).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    kind = rows.schema["_s"].dataType.simpleString()
    empty = F.expr(f"cast(array() as {kind})")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        changed = F.lit(False)
        for a in attributes:
            eq = same.get(a, lambda p, q: p == q)
            changed = changed | F.coalesce(~eq(last[a], x[a]), F.lit(False))
        merged = F.struct(last["at"].alias("at"), *[F.coalesce(last[a], x[a]).alias(a) for a in attributes])
        opened = F.struct(x["at"].alias("at"), *[F.coalesce(x[a], last[a]).alias(a) for a in attributes])
        return F.when(F.size(acc) == 0, F.array(x)).when(changed, F.concat(acc, F.array(opened))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged)))

    folded = rows.select(entity, F.aggregate("_s", empty, step).alias("_v"))
    out = folded.select(entity, F.posexplode("_v").alias("_i", "_x"), F.col("_v"))
    nxt = F.try_element_at("_v", F.col("_i") + 2)["at"]
    return out.select(entity, F.col("_x.at").alias("valid_from"), F.coalesce(month_before(nxt), F.lit(OPEN_END)).cast("long").alias("valid_to"), *[F.col(f"_x.{a}").alias(a) for a in attributes])


def _spelling(a: Column, b: Column) -> Column:
    """Two spellings of one word: few edits for the length."""
    n = F.greatest(F.length(a), F.length(b))
    return (a == b) | (F.levenshtein(a, b) * 4 <= n)


def _given_agree(a: Column, b: Column) -> Column:
    """Words before the last of a street name: missing ones agree with anything, an initial with its word.

    Linking words are left out; where one has fewer words, those it has count.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: ~w.isin("DE", "DA", "DO", "DAS", "DOS", "E", ""))
    pairs = F.arrays_zip(words(a).alias("x"), words(b).alias("y"))
    one = lambda p: p["x"].isNull() | p["y"].isNull() | (((F.length(p["x"]) == 1) | (F.length(p["y"]) == 1)) & (F.substring(p["x"], 1, 1) == F.substring(p["y"], 1, 1))) | _spelling(p["x"], p["y"])
    return F.coalesce(F.forall(pairs, one), F.lit(True))


def _same_town(a: Column, b: Column) -> Column:
    """Municipalities: those marked by a state must be one; else any place that is no quarter may be shared; missing agrees."""
    towns = lambda x: F.filter(x["places"], lambda p: ~p.rlike(r"^(" + "|".join(QUARTER_WORDS) + r")\b"))
    clear = lambda x: F.filter(towns(x), lambda p: ~p.startswith("VILA "))
    near = lambda x, y: F.exists(towns(x), lambda p: F.exists(towns(y), lambda q: _spelling(p, q)))
    marked = F.when(a["locality"].isNotNull() & b["locality"].isNotNull(), _spelling(a["locality"], b["locality"]))
    loose = (F.size(clear(a)) == 0) | (F.size(clear(b)) == 0) | near(a, b)
    return F.coalesce(a["uf"] == b["uf"], F.lit(True)) & F.coalesce(marked, loose)


def same_place(a: Column, b: Column) -> Column:
    """Whether two parsed addresses denote one location (street, number, municipality), level by level.

    Null when either denotes none. Levels not given (kind, title, given words,
    postal code, state, places) agree with anything; given ones must agree.
    """
    known = a["number"].isNotNull() & b["number"].isNotNull() & a["name"].isNotNull() & b["name"].isNotNull()
    ok = (
        (a["number"] == b["number"])
        & _spelling(a["name"], b["name"])
        & F.coalesce(a["kind"] == b["kind"], F.lit(True))
        & F.coalesce(a["title"] == b["title"], F.lit(True))
        & _given_agree(a["given"], b["given"])
        & F.coalesce(a["cep"] == b["cep"], _same_town(a, b))
    )
    return F.when(known, ok)


def store_history(hub: DataFrame) -> DataFrame:
    """Versions of NU_DCMT and DC_ENDR per NU_EC: nu_ec, cd_mes_de, cd_mes_ate, documento, endereco.

    A document counts as its digits when its check digits hold, else as not
    informed. An address counts as its parsed place; placeholders, and texts
    without street or number, are not informed. Rows without NU_EC or CD_MES
    are skipped; an empty table gives no rows.
    """
    rows = latest_load(hub, ["CD_MES", "NU_EC"], "DT_CRGA", ["NU_DCMT", "DC_ENDR"])
    p = address_parts("DC_ENDR")
    rows = rows.select(F.col("NU_EC").alias("nu_ec"), F.col("CD_MES").alias("cd_mes"), known_document(F.col("NU_DCMT")).alias("documento"), "DC_ENDR", p.alias("_p"))
    place = F.when(
        F.col("_p.number").isNotNull() & F.col("_p.street").isNotNull(),
        F.struct(F.col("_p.number").alias("number"), F.col("_p.street").alias("name"), *[F.col(f"_p.{c}").alias(c) for c in ("kind", "title", "given", "cep", "uf", "locality", "places")], F.col("DC_ENDR").alias("texto")),
    )
    rows = rows.select("nu_ec", "cd_mes", "documento", place.alias("lugar"))
    out = fold_versions(rows, "nu_ec", "cd_mes", ["documento", "lugar"], {"lugar": same_place})
    return out.select("nu_ec", F.col("valid_from").alias("cd_mes_de"), F.col("valid_to").alias("cd_mes_ate"), "documento", F.col("lugar.texto").alias("endereco"))
