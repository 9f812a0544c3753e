"""Timestamps in mixed forms, precisions and zones as one instant.

A value's own offset or zone holds. A civil time without one takes the zone
declared for its place; where none is declared, the zone is estimated by
aligning local times with ingestion: deliveries close at the end of a local
day, so under the right offset history the instants that are known at a place
fall on the local day their ingestion belongs to, and under a wrong one those
near midnight fall before or after it.
All expressions are native; results are milliseconds and do not depend on the
session time zone.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import Cuts, small

# First three letters of month names, Portuguese and English.
MONTHS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}

_DATE = r"^(\d{8}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ](?:\d{4}|\d{2})|\d{1,2}[-/. ](?:de )?[A-Za-z]{3}[a-zç.]*[-/. ](?:de )?(?:\d{4}|\d{2}))(?=$|[Tt ,])"
_ZONE = r"(?<![A-Za-z])(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)$"
_DAY_MS = 86_400_000


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse_moments(df: DataFrame, date: str, clock: str | None, out: str) -> DataFrame:
    """Adds ``out``: struct<day, ms, offset, zone, instant> of a date text and an optional clock text.

    ``day`` is the civil date, ``ms`` the milliseconds of day (0 where not
    given), ``offset`` minutes and ``zone`` the zone the value names itself;
    ``instant`` is set (milliseconds since 1970 UTC) for epoch numbers. A date
    text that is an instant by itself, or holds a clock when ``clock`` is null,
    sets the clock alone. Day leads month unless the year leads; two-digit
    years are 2000-2099; digits-only clocks have lost left zeros. Null, empty
    and unreadable texts give null fields. The steps are separate projections,
    each evaluated once.
    """
    col, c = F.col, F.lit(None).cast("string") if clock is None else F.trim(F.col(clock))
    keep = df.columns
    x = df.select(*keep, F.trim(col(date)).alias("_d"), F.nullif(c, F.lit("")).alias("_c"))
    x = x.select(*keep, "_d", "_c", F.regexp_extract("_d", _DATE, 1).alias("_date"))
    x = x.withColumn("_tail", F.when(col("_date") != "", F.nullif(F.regexp_replace(F.substr("_d", F.length("_date") + 1), r"^[Tt ,]+", ""), F.lit(""))))
    x = x.withColumn("_k", F.when(col("_tail").rlike(_ZONE), col("_tail")).otherwise(F.coalesce("_c", "_tail")))
    x = x.withColumn("_z", F.regexp_extract("_k", _ZONE, 1))
    x = x.withColumn("_b", F.trim(F.substring(col("_k"), F.lit(1), F.length("_k") - F.length("_z"))))
    x = x.withColumn("_half", F.lower(F.regexp_extract("_b", r"([AaPp])\.?[Mm]\.?$", 1)))
    x = x.withColumn("_b", F.when(col("_half") == "", col("_b")).otherwise(F.trim(F.regexp_replace("_b", r"[AaPp]\.?[Mm]\.?$", ""))))
    digits = F.regexp_replace(F.lpad(F.regexp_extract("_b", r"^\d{1,6}", 0), 6, "0"), r"(\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    x = x.withColumn("_t", F.split(F.when(col("_b").rlike(r"^\d{1,6}(?:[.,]\d+)?$"), F.concat(digits, F.regexp_extract("_b", r"[.,]\d+$", 0))).when(col("_b").rlike(r"^\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?$"), col("_b")), "[:.,]"))
    year_first = F.substring("_date", 1, 4).between("1900", "2199")
    spread = F.when(col("_date").rlike(r"^\d{8}$"), F.when(year_first, F.regexp_replace("_date", r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")).otherwise(F.regexp_replace("_date", r"(\d{2})(\d{2})(\d{4})", "$3-$2-$1")))
    x = x.withColumn("_p", F.split(F.coalesce(spread, F.regexp_replace("_date", r"[-/. ]+(?:de )?", "-")), "-"))
    part = lambda i: F.get("_p", i)
    ahead = F.length(part(0)) == 4
    year = F.when(ahead, part(0)).otherwise(part(2))
    month = F.create_map(*[F.lit(k) for kv in MONTHS.items() for k in kv])
    x = x.select(
        *keep, "_d", "_z", "_half", "_t",
        F.when(F.length(year) == 2, _int(year) + 2000).otherwise(_int(year)).alias("_y"),
        F.coalesce(_int(part(1)), F.try_element_at(month, F.lower(F.substring(part(1), 1, 3)))).alias("_m"),
        _int(F.when(ahead, part(2)).otherwise(part(0))).alias("_dd"),
        _int(F.get("_t", 0)).alias("_h"), _int(F.get("_t", 1)).alias("_mi"), F.coalesce(_int(F.get("_t", 2)), F.lit(0)).alias("_s"),
        F.coalesce(_int(F.substring(F.rpad(F.get("_t", 3), 3, "0"), 1, 3)), F.lit(0)).alias("_f"),
    )
    x = x.withColumn("_h", F.when((col("_half") == "p") & (col("_h") < 12), col("_h") + 12).when((col("_half") == "a") & (col("_h") == 12), 0).otherwise(col("_h")))
    text_day = F.format_string("%04d-%02d-%02d", "_y", "_m", "_dd")
    day = F.when(col("_y").isNotNull() & col("_m").isNotNull() & col("_dd").isNotNull(), F.expr("try_cast(_day as date)"))
    x = x.withColumn("_day", text_day)
    ok = (col("_h") < 24) & (col("_mi") < 60) & (col("_s") < 60)
    ms = F.when(ok, ((col("_h") * 60 + col("_mi")) * 60 + col("_s")).cast("long") * 1000 + col("_f"))
    sign = F.when(col("_z").startswith("-"), -1).otherwise(1)
    bare = F.regexp_replace("_z", r"[^0-9]", "")
    offset = F.when(col("_z").isin("Z", "z", "UTC", "GMT"), 0).when(col("_z").rlike(r"^[+-]"), sign * (_int(F.substring(bare, 1, 2)) * 60 + F.coalesce(_int(F.nullif(F.substring(bare, 3, 2), F.lit(""))), F.lit(0))))
    epoch = F.when(col("_d").rlike(r"^\d{13}$"), col("_d").try_cast("long")).when(col("_d").rlike(r"^\d{9,10}$"), col("_d").try_cast("long") * 1000).when(col("_d").rlike(r"^\d{16}$"), F.floor(col("_d").try_cast("long") / 1000))
    x = x.select(*keep, "_z", day.alias("_day"), F.coalesce(ms, F.lit(0)).cast("long").alias("_ms"), offset.cast("int").alias("_offset"), epoch.alias("_instant"))
    x = x.withColumn("_zone", F.when(col("_z").contains("/") & col("_z").isin(sorted(zoneinfo.available_timezones())), col("_z")))
    return x.select(*keep, F.struct(col("_day").alias("day"), col("_ms").alias("ms"), col("_offset").alias("offset"), col("_zone").alias("zone"), col("_instant").alias("instant")).alias(out))


def civil_to_instant(day: Column, ms: Column, zone: Column) -> Column:
    """Milliseconds since 1970 UTC of a civil time; a time that occurs twice is the first, one that is skipped moves on by the gap."""
    local = F.timestamp_add("MILLISECOND", ms, day.cast("timestamp_ntz"))
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.convert_timezone(zone, F.lit("UTC"), local))


def moment_to_instant(p: Column, civil_zone: Column) -> Column:
    """The instant of a parsed moment; null when it was unreadable."""
    days = F.unix_date(p["day"]).cast("long") * _DAY_MS
    return F.coalesce(
        p["instant"],
        F.when(p["offset"].isNotNull(), days + p["ms"] - p["offset"].cast("long") * 60_000),
        F.when(p["day"].isNotNull(), civil_to_instant(p["day"], p["ms"], F.coalesce(p["zone"], civil_zone, F.lit("UTC")))),
    )


def usual_lag(df: DataFrame, parsed: str, ingested: str) -> DataFrame:
    """One row: the most frequent number of days from a civil day to its ingestion (ties: the least)."""
    lag = F.datediff(F.col(ingested), F.col(f"{parsed}.day")).alias("_lag")
    n = df.where(F.col(f"{parsed}.day").isNotNull() & F.col(ingested).isNotNull() & F.col(f"{parsed}.offset").isNull() & F.col(f"{parsed}.zone").isNull()).groupBy(lag).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.max(F.struct("_n", (-F.col("_lag")).alias("l"))).alias("_t")).select(F.coalesce(-F.col("_t.l"), F.lit(0)).alias("_lag"))


def estimate_zones(df: DataFrame, group: Sequence[str], parsed: str, ingested: str, zones: DataFrame, zone_col: str) -> DataFrame:
    """group, zone, violations, rows, tied: the candidate zone with the fewest violations per group.

    ``zones`` is the bounded list of candidate zones, ``ingested`` the day of
    ingestion. A known instant (its value names an offset or zone, or is an
    epoch number) violates a candidate where its local day under it is not the
    ingestion day less the usual lag: too far east it falls after, too far west
    before. Ties go to the offsets most values of the group name, then to the
    zone's name; ``tied`` counts the candidates with equally few violations.
    A civil time without offset is told by its local day whatever the zone, so
    it informs the usual lag only. Rows are first counted per (group, quarter
    of an hour, ingestion day, own offset), so the candidates multiply compact
    states, not rows. Null groups form one group; a group without known
    instants has no row.
    """
    p = lambda f: F.col(f"{parsed}.{f}")
    known = df.where(F.col(ingested).isNotNull() & (p("instant").isNotNull() | (p("day").isNotNull() & (p("offset").isNotNull() | p("zone").isNotNull()))))
    quarter = F.floor(moment_to_instant(F.col(parsed), F.lit("UTC")) / 900_000).alias("_q")
    states = known.groupBy(*group, quarter, F.col(ingested).alias("_i"), p("offset").alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    cand = zones.select(F.col(zone_col).alias("_z")).where(F.col("_z").isNotNull()).distinct().agg(F.array_sort(F.collect_list("_z")).alias("_zs"))
    one = lambda x: x.withColumn("_one", F.lit(1))
    # two frames of one row each
    tried = one(states).join(F.broadcast(one(cand)), "_one").join(F.broadcast(one(usual_lag(df, parsed, ingested))), "_one").select(*group, "_q", "_i", "_o", "_n", "_lag", F.explode("_zs").alias("_z"))
    utc = F.timestamp_add("MILLISECOND", F.col("_q") * 900_000, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    tried = tried.withColumn("_utc", utc).withColumn("_at", F.convert_timezone(F.lit("UTC"), F.col("_z"), F.col("_utc")))
    bad = F.to_date("_at") != F.date_sub(F.col("_i"), F.col("_lag"))
    vote = F.timestamp_diff("MINUTE", F.col("_utc"), F.col("_at")) == F.col("_o")
    scored = tried.groupBy(*group, "_z").agg(F.sum(F.when(bad, F.col("_n")).otherwise(0)).alias("violations"), F.sum(F.when(vote, F.col("_n")).otherwise(0)).alias("_v"), F.sum("_n").alias("rows"))
    item = F.struct("violations", (-F.col("_v")).alias("v"), F.col("_z").alias("zone"), "rows")
    best = scored.groupBy(*group).agg(F.min(item).alias("_b"), F.collect_list("violations").alias("_all"))
    return best.select(*group, "_b.zone", "_b.violations", "_b.rows", F.size(F.filter("_all", lambda v: v == F.col("_b.violations"))).alias("tied"))


def card_moments(cards: DataFrame) -> DataFrame:
    """One row per message with a date: qt_cnar_ordm, place, parsed moment, ingestion day.

    Copies of a message collapse before the parse; of copies that differ the
    first loaded with a date counts (ties: least texts).
    """
    first = F.min(F.struct("dt_crga", "dt_oprc", "hr_oprc", "cd_pais_estn", "sg_uf")).alias("_m")
    m = cards.where(F.col("dt_oprc").isNotNull() & F.col("qt_cnar_ordm").isNotNull()).groupBy("qt_cnar_ordm").agg(first)
    m = m.select("qt_cnar_ordm", "_m.cd_pais_estn", "_m.sg_uf", "_m.dt_oprc", "_m.hr_oprc", F.expr("try_cast(_m.dt_crga as date)").alias("dia_crga"))
    return parse_moments(m, "dt_oprc", "hr_oprc", "p").drop("dt_oprc", "hr_oprc")


def with_civil_zone(moments: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds ``nm_fuso``: declared for (cd_pais_estn, sg_uf), else estimated from ingestion.

    The declared list is broadcast when its size allows, else joined by hash.
    The parsed moments are written once; the estimate runs only where some
    place has no declared zone.
    """
    key = lambda p, u: F.concat_ws("|", F.coalesce(p, F.lit("")), F.coalesce(u, F.lit("")))
    declared = zones.groupBy(key(F.col("cd_pais_estn"), F.col("sg_uf")).alias("_k")).agg(F.min("nm_fuso").alias("_z"))
    m = moments.withColumn("_k", key(F.col("cd_pais_estn"), F.col("sg_uf")))
    m = m.join(F.broadcast(declared) if small(zones) else declared, "_k", "left")
    m = Cuts(moments.sparkSession, "moments").put(m)
    loose = m.where(F.col("_z").isNull() & F.col("p.zone").isNull() & F.col("p.instant").isNull())
    if loose.isEmpty():
        return m.withColumnRenamed("_z", "nm_fuso").drop("_k")
    guess = estimate_zones(loose, ["_k"], "p", "dia_crga", zones, "nm_fuso").select("_k", F.col("zone").alias("_g"))
    return m.join(guess, "_k", "left").withColumn("nm_fuso", F.coalesce("_z", "_g")).drop("_k", "_z", "_g")


def card_instants(cards: DataFrame, zones: DataFrame) -> DataFrame:
    """chave, instante_ms of each message; unreadable dates give a null instant."""
    m = with_civil_zone(card_moments(cards), zones)
    return m.select(F.col("qt_cnar_ordm").cast("string").alias("chave"), moment_to_instant(F.col("p"), F.col("nm_fuso")).alias("instante_ms"))


def hub_instants(hub: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    """chave, instante_ms of each store-month with a debt date; of reloads the last with a date counts."""
    last = F.max(F.struct("DT_CRGA", "DT_DBTO_PNDT")).alias("_m")
    h = hub.where(F.col("DT_DBTO_PNDT").isNotNull()).groupBy("CD_MES", "NU_EC").agg(last)
    h = h.select(F.concat_ws("-", F.col("CD_MES").cast("string"), F.col("NU_EC").cast("string")).alias("chave"), F.col("_m.DT_DBTO_PNDT").alias("_text"))
    return parse_moments(h, "_text", None, "p").select("chave", moment_to_instant(F.col("p"), F.lit(zone)).alias("instante_ms"))
