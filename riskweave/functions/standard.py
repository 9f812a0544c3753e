"""Standard forms of phones, addresses, names, e-mails, accounts, times and amounts.

Native expressions only; each maps null to null unless it says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.expr import let

# Accented letters and their plain forms.
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"
# Street kinds that are written out at the start of an address.
STREET_STARTS = {
    "R": "RUA", "AV": "AVENIDA", "TV": "TRAVESSA", "AL": "ALAMEDA", "PCA": "PRACA", "ROD": "RODOVIA",
    "EST": "ESTRADA", "LAD": "LADEIRA", "VD": "VIADUTO", "PQ": "PARQUE", "JD": "JARDIM", "LGO": "LARGO",
}
# State names and their codes.
STATES = {
    "SAO PAULO": "SP", "RIO DE JANEIRO": "RJ", "MINAS GERAIS": "MG", "PARANA": "PR", "RIO GRANDE DO SUL": "RS", "BAHIA": "BA", "PERNAMBUCO": "PE",
    "CEARA": "CE", "DISTRITO FEDERAL": "DF", "GOIAS": "GO", "SANTA CATARINA": "SC", "AMAZONAS": "AM", "PARA": "PA",
}
# Classes of written documents, tried in this order.
DOCUMENT_FORMATS = {
    "masked_person": r"^\d{3}\.\d{3}\.\d{3}-\d{2}$",
    "masked_company": r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$",
    "digits": r"^\d{11}$|^\d{14}$",
    "digits_short": r"^\d+$",
}


def unaccent_upper(c: Column) -> Column:
    return F.upper(F.translate(c, ACCENTED, PLAIN))


def document_format(c: Column) -> Column:
    """One of six classes: null, two masks, full digits, other digits, other."""
    out = F.when(c.isNull(), "null")
    for name, pattern in DOCUMENT_FORMATS.items():
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("other")


def phone_e164(c: Column, area: Column | None = None) -> Column:
    """``+55`` and 10 or 11 digits, else null.

    A leading 55 is dropped from 12 digits on; the area code is put before 8 or
    9 digits where one is given.
    """

    def national(d: Column) -> Column:
        return F.when((F.length(d) >= 12) & d.startswith("55"), F.substring(d, 3, 20)).otherwise(d)

    d = let(F.regexp_replace(c, r"\D", ""), national)
    if area is not None:
        d = let(d, lambda x: F.when(F.length(x).isin(8, 9), F.concat(F.regexp_replace(area, r"\D", ""), x)).otherwise(x))
    return let(d, lambda x: F.when(F.length(x).isin(10, 11), F.concat(F.lit("+55"), x)))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Z0-9 ]", " "), r"\s+", " "))


def address_std(c: Column) -> Column:
    """Plain upper case without postal code, number mark and punctuation; the street kind at the start written out; empty gives null."""
    e = F.regexp_replace(unaccent_upper(c), r"\s*-?\s*CEP\s*[\d.\-]+", "")
    e = _squeezed(F.regexp_replace(e, r"\bN\s*[º°O]?\.?\s*(?=\d)", ""))
    # the first word decides, so one lookup replaces a chain of patterns
    word = F.regexp_extract(e, r"^([A-Z]+)\b", 1)
    full = F.create_map(*[F.lit(x) for kv in STREET_STARTS.items() for x in kv])[word]
    e = F.when(full.isNull(), e).otherwise(F.concat(full, F.substr(e, F.length(word) + 1)))
    return F.nullif(e, F.lit(""))


def name_std(c: Column) -> Column:
    """Plain upper case letters and digits, single blanks; empty gives null."""
    return F.nullif(_squeezed(unaccent_upper(c)), F.lit(""))


def email_std(c: Column) -> Column:
    """Lower case without surrounding blanks; null unless it has the form of an address."""
    return let(F.lower(F.trim(c)), lambda e: F.when(e.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), e))


def account_key(ispb: Column, branch: Column, account: Column) -> Column:
    """``ispb|branch|account`` without leading zeros; a part that is no number is left out, and null where all are."""
    number = lambda c: c.cast("string").try_cast("bigint").cast("string")
    return F.nullif(F.concat_ws("|", ispb.cast("string"), number(branch), number(account)), F.lit(""))


def mixed_timestamp(date: Column, clock: Column) -> Column:
    """``yyyyMMdd`` or ``yyyy-MM-dd`` and a clock with or without colons and left zeros; unreadable gives null."""
    d = date.cast("string")
    day = F.coalesce(F.try_to_timestamp(d, F.lit("yyyyMMdd")), F.try_to_timestamp(d, F.lit("yyyy-MM-dd")))
    h = F.lpad(F.regexp_replace(clock.cast("string"), ":", ""), 6, "0")
    part = lambda i: F.substring(h, i, 2).try_cast("int")
    return day + F.make_dt_interval(F.lit(0), part(1), part(3), part(5))


def payment_key_type(c: Column) -> Column:
    """PHONE, EMAIL, EVP (random key), DOCUMENT or null."""
    return F.when(c.startswith("+55"), "PHONE").when(c.contains("@"), "EMAIL").when(c.rlike(r"^[0-9a-f]{32}$"), "EVP").when(c.rlike(r"^\d{11}$|^\d{14}$"), "DOCUMENT")


def state_code(c: Column) -> Column:
    """The two-letter code of a state's name; other texts in upper case without surrounding blanks."""
    name = F.upper(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[name], name)


def strip_municipality(address: Column, municipality: Column) -> Column:
    """The address up to a comma followed by its municipality (taken literally); unchanged where that is null."""
    at = F.regexp_instr(address, F.concat(F.lit(r",\s*\Q"), municipality, F.lit(r"\E")))
    return F.when(municipality.isNotNull() & (at > 0), F.substring(address, F.lit(1), at - 1)).otherwise(address)


def decimal_comma(c: Column) -> Column:
    """A number with decimal comma (dots group thousands) or decimal point; unreadable gives null."""
    return F.when(c.contains(","), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c).try_cast("double")


def _winkler(a: str, b: str, scale: float = 0.1, boost: float = 0.7) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro) if jaro > boost else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity over Arrow batches; apply it to distinct pairs. A null side gives null."""
    return pd.Series([None if x is None or y is None else _winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
