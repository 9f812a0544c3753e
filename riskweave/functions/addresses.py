"""Grammar of hand-typed postal addresses.

``parse_address`` splits one text into street kind, street words, house number,
postal code, state and the remaining place segments. It decides nothing about
other records; the hierarchy matcher and the attribute history build on it.

Null, blank and placeholder texts give ``None``. Texts of any length are read
whole; every loop is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Street kinds and their written forms.
STREET_KINDS = {
    "RUA": "RUA", "R": "RUA",
    "AVENIDA": "AVENIDA", "AV": "AVENIDA", "AVDA": "AVENIDA", "AVEN": "AVENIDA",
    "TRAVESSA": "TRAVESSA", "TV": "TRAVESSA", "TRAV": "TRAVESSA",
    "ALAMEDA": "ALAMEDA", "AL": "ALAMEDA", "ALAM": "ALAMEDA",
    "ESTRADA": "ESTRADA", "EST": "ESTRADA", "ESTR": "ESTRADA",
    "RODOVIA": "RODOVIA", "ROD": "RODOVIA",
    "PRACA": "PRACA", "PCA": "PRACA", "PC": "PRACA", "PRC": "PRACA",
    "LARGO": "LARGO", "LGO": "LARGO", "LG": "LARGO",
    "VIELA": "VIELA", "BECO": "BECO", "LADEIRA": "LADEIRA",
}

# Titles in street names and their written forms.
TITLES = {
    "PADRE": "PADRE", "PE": "PADRE",
    "DOUTOR": "DOUTOR", "DR": "DOUTOR", "DOUTORA": "DOUTOR", "DRA": "DOUTOR",
    "PRESIDENTE": "PRESIDENTE", "PRES": "PRESIDENTE",
    "GENERAL": "GENERAL", "GEN": "GENERAL", "GAL": "GENERAL",
    "CAPITAO": "CAPITAO", "CAP": "CAPITAO",
    "CORONEL": "CORONEL", "CEL": "CORONEL",
    "MARECHAL": "MARECHAL", "MAL": "MARECHAL", "MAR": "MARECHAL",
    "ENGENHEIRO": "ENGENHEIRO", "ENG": "ENGENHEIRO", "ENGO": "ENGENHEIRO",
    "PROFESSOR": "PROFESSOR", "PROF": "PROFESSOR", "PROFESSORA": "PROFESSOR", "PROFA": "PROFESSOR",
    "COMENDADOR": "COMENDADOR", "COM": "COMENDADOR", "COMEND": "COMENDADOR",
    "SAO": "SANTO", "SANTO": "SANTO", "SANTA": "SANTO", "STO": "SANTO", "STA": "SANTO", "S": "SANTO",
    "VISCONDE": "VISCONDE", "VISC": "VISCONDE", "BARAO": "BARAO", "DOM": "DOM", "D": "DOM",
    "MAJOR": "MAJOR", "MAJ": "MAJOR", "TENENTE": "TENENTE", "TEN": "TENENTE",
    "SENADOR": "SENADOR", "SEN": "SENADOR", "DEPUTADO": "DEPUTADO", "DEP": "DEPUTADO",
}

# Words that open a unit inside a building.
UNIT_WORDS = "APTO AP APT APARTAMENTO SALA SL LOJA LJ CASA CS BLOCO BL FUNDOS FDS ANDAR CONJ CJ SOBRELOJA GALPAO BOX TERREO LOTE LT QUADRA QD".split()
# Words that open a neighbourhood.
QUARTER_WORDS = "CENTRO JARDIM JD BAIRRO CONJUNTO PARQUE PQ PQE RESIDENCIAL NUCLEO LOTEAMENTO SETOR DISTRITO".split()
# Texts that stand for a missing address, without accents and punctuation.
PLACEHOLDERS = set("NAO INFORMADO|SEM ENDERECO|N I|NI|N A|NA|NULL|NONE|X|XX|XXX|XXXX|XXXXX|NAO CONSTA|NAO TEM|SEM INFORMACAO|DESCONHECIDO|A CONFIRMAR|ENDERECO|S N|SN|NAO DECLARADO|INEXISTENTE|TESTE|0|00|000|A DEFINIR|NAO DISPONIVEL|INDISPONIVEL|IGNORADO|SEM DADOS|PENDENTE|NIHIL|VAZIO".split("|"))

_UFS = "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split()
_CEP = re.compile(r"(?:\bCEP\b[\s:.º°]*)?\b(\d{5})[-.\s]?(\d{3})\b(?!\d)")
_CEP_WORD = re.compile(r"\bCEP\b[\s:.]*")
_UF = re.compile(r"\s*[/]\s*(" + "|".join(_UFS) + r")\b")
_NUMBER = re.compile(r"\b(?:NUMERO|NUM|NRO|NR|NO|N)(?:[\s.:º°]*)(\d+)\b")
_UNIT = re.compile(r"\b(?:" + "|".join(UNIT_WORDS) + r")\b\.?(?:\s*(?:N[O.º]?\s*)?(?:\d+\s*[A-Z]?\b|[A-Z]\b(?!\.)))?")
_WORDS = re.compile(r"[A-Z0-9']+")
_QUARTER = re.compile(r"^(?:" + "|".join(QUARTER_WORDS) + r")\b")

FIELDS = "kind title street number cep uf places"
SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("given", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("number", T.StringType()),
        T.StructField("cep", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("locality", T.StringType()),
        T.StructField("places", T.ArrayType(T.StringType())),
    ]
)


def plain(text: str) -> str:
    """Upper case without accents; letter-like ordinals stay readable (nº -> NO)."""
    text = text.replace("º", "O").replace("°", "O").replace("ª", "A")
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).upper()


def _street_words(words: list[str]) -> tuple[str | None, str | None, list[str]]:
    """Kind, title and remaining words of a street segment."""
    kind = title = None
    if words and words[0] in STREET_KINDS and len(words) > 1:
        kind, words = STREET_KINDS[words[0]], words[1:]
    if words and words[0] in TITLES and len(words) > 1:
        title, words = TITLES[words[0]], words[1:]
    return kind, title, words


def parse_address(text: str | None) -> tuple | None:
    """(kind, title, given, street, number, cep, uf, locality, places) or None."""
    if text is None:
        return None
    t = re.sub(r"\s+", " ", plain(text)).strip()
    bare = " ".join(_WORDS.findall(t))
    if not bare or bare in PLACEHOLDERS:
        return None
    cep = None
    found = None
    for m in _CEP.finditer(t):
        found = m  # the last one: a postal code ends an address or stands alone before it
        if m.group(0).startswith("CEP"):
            break
    if found:
        cep = found.group(1) + found.group(2)
        t = t[: found.start()] + " , " + t[found.end() :]
    t = _CEP_WORD.sub(" ", t)
    uf = locality_end = None
    m = _UF.search(t)
    if m:
        uf, locality_end = m.group(1), m.start()
        t = t[: m.start()] + " \x01" + t[m.end() :]
    t = _NUMBER.sub(r" \1 ", t)
    t = re.sub(r"\s+", " ", t)
    segments = [s.strip(" .;:") for s in re.split(r"\s*,\s*|\s+-\s+|;|\|", t)]
    segments = [s for s in segments if s]
    kind = title = number = None
    street: list[str] = []
    places: list[str] = []
    locality = None
    anchor = None
    units: list[str] = []
    for i, s in enumerate(segments):
        w = [x.strip("'") for x in _WORDS.findall(s)]
        if w and (w[0] in STREET_KINDS and len(w) > 1 or w[0].isdigit() and len(w) > 2 and w[1] in STREET_KINDS):
            anchor = i
            break
    if anchor is None:  # no kind was typed: the segment that carries or precedes the number
        for i, s in enumerate(segments):
            w = _WORDS.findall(s)
            if i and w and w[0].isdigit() and (len(w) == 1 or w[1] in UNIT_WORDS):
                anchor = i - 1
                break
            if any(x.isdigit() for x in w) and any(not x.isdigit() for x in w) and not _UNIT.match(s):
                anchor = i
                break
        if anchor is None:
            anchor = 0
    rest: list[str] = []
    for i, s in enumerate(segments):
        if i == anchor:
            w = [x.strip("'") for x in _WORDS.findall(s.replace("\x01", ""))]
            if w and w[0].isdigit() and len(w) > 1:
                number, w = w[0], w[1:]
            at = next((j for j, x in enumerate(w) if x.isdigit() and j), None) if number is None else None
            if number is not None:  # number first: the street runs to a unit word
                body, tail = w, []
                at2 = next((j for j, x in enumerate(w) if j and x in UNIT_WORDS), None)
                if at2 is not None:
                    body, tail = w[:at2], w[at2:]
            elif at is not None:
                number, body, tail = w[at], w[:at], w[at + 1 :]
            else:
                at2 = next((j for j, x in enumerate(w) if j and x in UNIT_WORDS), None)
                body, tail = (w, []) if at2 is None else (w[:at2], w[at2:])
            kind, title, street = _street_words(body)
            if tail:
                rest.append(" ".join(tail) + (" \x01" if "\x01" in s else ""))
        else:
            rest.append(s)
    for s in rest:
        mark = "\x01" in s
        s = s.replace("\x01", "").strip()
        w = _WORDS.findall(s)
        if number is None and w and w[0].isdigit():
            number, w = w[0], w[1:]
            s = " ".join(w)
        s = _UNIT.sub(" , ", s) if not (mark and not any(x.isdigit() for x in w) and (not w or w[0] not in UNIT_WORDS)) else s
        for part in s.split(","):
            w = _WORDS.findall(part)
            w = [x for x in w if not x.isdigit()]
            if w:
                places.append(" ".join(w))
        if mark and places:
            locality = places[-1]
    # Without separators, quarter and locality stand in one run: cut before a quarter word and after its name.
    out: list[str] = []
    for p in places:
        w = p.split()
        if _QUARTER.match(p) and len(w) > 2:
            out += [" ".join(w[:2]), " ".join(w[2:])]
        elif w[0] == "VILA" and len(w) > 3:
            out += [" ".join(w[:2]), " ".join(w[2:])]
        else:
            out.append(p)
    if locality is not None and locality not in out and out:
        locality = out[-1]
    given = None
    if len(street) > 1:
        given, street = " ".join(street[:-1]), street[-1:]
    name = street[0] if street else None
    number = number.lstrip("0") or "0" if number else None
    if name is None and number is None and cep is None and not out:
        return None
    return kind, title, given, name, number, cep, uf, locality, out


@F.pandas_udf(SCHEMA)
def address_parts(texts: pd.Series) -> pd.DataFrame:
    """Arrow-batched ``parse_address``; every field is null where the text denotes no place."""
    memo: dict = {}
    rows = []
    for x in texts:
        x = None if x is None or x != x else x
        if x not in memo:
            memo[x] = parse_address(x) or (None,) * 9
        rows.append(memo[x])
    return pd.DataFrame(rows, columns=SCHEMA.names, dtype=object)
