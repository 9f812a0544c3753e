"""Words of hand-typed names of persons and organisations.

``name_words`` brings one text to plain words in natural order; ``describe``
says what a list of words names. Neither looks at other records.
"""

from __future__ import annotations

import functools
import re

from riskweave.functions.addresses import PLACEHOLDERS, plain

# Given names.
GIVEN = set(
    "ADRIANA ALEXANDRE ANA ANTONIO APARECIDA AUGUSTO BEATRIZ BENEDITO CARLOS CECILIA CONCEICAO COSME CRISTINA DAMIAO DANIELA DEBORA EDUARDO ESTEVAO EVARISTO FATIMA "
    "FERNANDA FERNANDO FRANCISCO GABRIEL GABRIELA HELENA HELOISA HENRIQUE ICARO IRINEU ISABEL JACIRA JOAO JOAQUIM JOSE JULIANA KATIA LAZARO LEONARDO LIVIA LUCIANA LUIZ "
    "MANUEL MARGARIDA MARIA MARIANA MONICA NAIR NELSON NORBERTO OLIVIA OSMAR OTAVIO PALMIRA PATRICIA PAULO PEDRO PERICLES QUERINO QUITERIA RAFAEL RAFAELA RAIMUNDO "
    "ROBERTO RODRIGO ROMULO ROSANGELA SALETE SEBASTIAO SONIA TATIANA TERESA TULIO UBIRAJARA URSULA VALDIR VANESSA VICENTE VITOR WAGNER WILMA XENIA YASMIN ZELIA ZULEICA "
    "LUIS LUCAS MARCOS MARCELO MARCIA PAULA RITA ROSA SERGIO TIAGO BRUNO CAMILA CARLA CLAUDIA DIEGO FABIO FELIPE GUSTAVO JULIO LARISSA LEANDRO RENATA RICARDO SANDRA SIMONE VERA".split()
)
# Short forms whose letters do not begin the given name.
NICKNAMES = {
    "BASTIAO": "SEBASTIAO", "TIAO": "SEBASTIAO", "BEL": "ISABEL", "BELINHA": "ISABEL", "BETO": "ROBERTO NORBERTO", "BIA": "BEATRIZ", "BIEL": "GABRIEL", "CACA": "CARLOS",
    "CEICAO": "CONCEICAO", "CHICO": "FRANCISCO", "CHIQUINHO": "FRANCISCO", "KIKO": "FRANCISCO HENRIQUE", "CIDA": "APARECIDA", "CIDINHA": "APARECIDA", "DIGO": "RODRIGO", "DITO": "BENEDITO",
    "DRI": "ADRIANA", "DRICA": "ADRIANA", "DUDU": "EDUARDO", "GUIDA": "MARGARIDA", "JOCA": "JOAO JOAQUIM JOSE", "LENINHA": "HELENA", "LENA": "HELENA", "MUNDINHO": "RAIMUNDO", "NANDA": "FERNANDA",
    "NANDO": "FERNANDO", "NECO": "MANUEL", "PEPE": "PERICLES PEDRO JOSE", "QUIM": "JOAQUIM", "QUINCAS": "JOAQUIM", "RIQUE": "HENRIQUE", "ROSA": "ROSANGELA ROSA", "TECA": "TERESA", "TONHO": "ANTONIO",
    "TONINHO": "ANTONIO", "TONICO": "ANTONIO", "XANDE": "ALEXANDRE", "ZE": "JOSE", "ZECA": "JOSE", "ZEZE": "JOSE", "DEBINHA": "DEBORA", "TUCA": "TULIO", "NENA": "HELENA",
    "ZINHO": "JOSE", "MANECO": "MANUEL", "MANE": "MANUEL", "LULU": "LUCIANA LUIZ", "JUCA": "JOSE JOAQUIM", "PATI": "PATRICIA", "GUTO": "AUGUSTO", "GABI": "GABRIELA", "SANDRO": "ALEXANDRE", "NINA": "CRISTINA",
}
# Trades and their written forms.
TRADES = {f: t for t, fs in {
    "PAPELARIA": "PAPELARIA PAPELAR PAPEL", "MERCEARIA": "MERCEARIA MERCEAR MERC", "SUPERMERCADO": "SUPERMERCADO SUPERM SUPER", "ELETRONICOS": "ELETRONICOS ELETRON ELETR", "BEBIDAS": "BEBIDAS BEB",
    "CLINICA": "CLINICA CLIN", "PECAS": "PECAS AUTOPECAS", "TRANSPORTES": "TRANSPORTES TRANSP TRANSPS", "CONSTRUCAO": "CONSTRUCAO CONSTR CONST", "JOALHERIA": "JOALHERIA JOALH JOAL",
    "RESTAURANTE": "RESTAURANTE RESTAUR REST", "PADARIA": "PADARIA PAD PANIF PANIFICADORA", "CONFECCOES": "CONFECCOES CONFEC CONF", "DISTRIBUIDORA": "DISTRIBUIDORA DISTRIB DIST", "FARMACIA": "FARMACIA FARMAC FARM",
}.items() for f in fs.split()}
# Words beside a trade that name nobody.
BESIDE = set("COMERCIO COM AUTO MATERIAIS MAT".split())
# Additions to the names of organisations.
ADDITIONS = set("VALE SERRA PORTO CENTRAL NOVA IRMAOS FILHOS CIA ASSOCIADOS".split())
# Legal forms, forms of address and linking words.
LEGAL = set("LTDA ME MEI EPP EIRELI SA".split())
FORMS = set("SR SRA DR DRA SRTA DONA".split())
LINKS = set("DE DA DO DAS DOS E".split())
# Texts that stand for a missing name, beside those of addresses.
NOBODY = PLACEHOLDERS | set("CLIENTE|SEM NOME|NOME|TITULAR|PORTADOR|CONSUMIDOR|NOME NAO INFORMADO|CLIENTE NAO INFORMADO|CONSUMIDOR FINAL".split("|"))

#: Words that are never taken for misspellings.
KNOWN = GIVEN | set(NICKNAMES) | set(TRADES) | BESIDE | ADDITIONS

_JOINED = re.compile(r"(?<=[A-Z])[01]|[01](?=[A-Z])")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent exchanges as one edit; ``most`` + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def name_words(text: str | None) -> list[str] | None:
    """Plain words in natural order, or None where the text names nobody.

    Legal forms, forms of address and linking words are left out; ``KEY, REST``
    and ``KEY/REST`` are turned round; digits among letters are read as letters.
    """
    if text is None:
        return None
    t = re.sub(r"\bS\s*[./]?\s*A\b\.?\s*$", "SA", plain(text).strip())
    if " ".join(re.findall(r"[A-Z0-9]+", t)) in NOBODY:
        return None
    letter = lambda m: "O" if m[0] == "0" else "I"
    t = _JOINED.sub(letter, _JOINED.sub(letter, t))
    front, comma, back = re.sub(r"\s-\s.*$", "", t).partition("," if "," in t else "/")
    # a leading E, or one before a point, is an initial
    words = lambda x: [m[0] for m in re.finditer(r"[A-Z]+", x) if m[0] not in LEGAL and m[0] not in FORMS and (m[0] not in LINKS or (m[0] == "E" and (not x[: m.start()].strip() or x[m.end() : m.end() + 1] == ".")))]
    a, b = words(front), words(back)
    w = b + a if comma and a and b and len(a) == 1 else a + b
    return w or None


@functools.lru_cache(maxsize=50_000)
def given_candidates(w: str) -> list[str]:
    """Full given names a first word may stand for; itself where it is no short form."""
    if w in NICKNAMES:
        return sorted(NICKNAMES[w].split())
    if w in GIVEN:
        return [w]
    stem = w.rstrip("S")
    if len(stem) > 5 and stem[-4:] in ("INHO", "INHA"):
        stem = stem[:-4].removesuffix("Z")
        stems = (stem, stem[:-2] + "C") if stem.endswith("QU") else (stem,)
        found = sorted(g for g in GIVEN if g.startswith(stems))
        if found:
            return found
    if len(w) <= 5:
        found = sorted(g for g in GIVEN if g.startswith(w))
        if found:
            return found
    return [w]


def _is_given(w: str) -> bool:
    return w in GIVEN or w in NICKNAMES or (len(w) > 5 and w.rstrip("S")[-4:] in ("INHO", "INHA"))


def describe(words: list[str], typed: dict[str, str] | None = None) -> tuple | None:
    """(kind, key, first, second, firsts, third) or None.

    A person (P): family word, given word or initial, middle words as typed,
    the full given names the given word may stand for, middle words corrected.
    An organisation (O): distinctive word, trade, addition, none, none.
    ``typed`` gives corrected words as they were written.
    """
    trade = next((TRADES[x] for x in words if x in TRADES), None)
    addition = next((x for x in words if x in ADDITIONS), None)
    w = [x for x in words if x not in BESIDE] or words
    if trade or addition or len(w) == 1:
        core = [x for x in w if x not in TRADES and x not in ADDITIONS and len(x) > 1]
        key = max(core, key=lambda x: (len(x), x), default=None)
        return ("O", key, trade, addition, None, None) if key and len(key) > 2 else None
    if not _is_given(w[0]) and len(w[0]) > 1 and _is_given(w[1]):
        w = [*w[1:], w[0]]
    if len(w[-1]) < 3:
        return None
    first = w[0]
    return "P", w[-1], first, " ".join((typed or {}).get(x, x) for x in w[1:-1]) or None, None if len(first) == 1 else given_candidates(first), " ".join(w[1:-1]) or None


@functools.lru_cache(maxsize=200_000)
def word_likeness(a: str, b: str) -> float:
    """1 for one word, 0.9 for initials and short forms, less for typing errors, 0 for other words."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.9 if b[0] == a or any(g[0] == a for g in NICKNAMES.get(b, "").split()) else 0.0
    if set(given_candidates(a)) & set(given_candidates(b)) or (a in TRADES and TRADES[a] == TRADES.get(b)):
        return 0.9
    if a in KNOWN and b in KNOWN:
        return 0.0
    most = max(1, len(b) // 4)
    d = edits(a, b, most)
    return 1 - d / len(b) if d <= most else 0.9 if a in b and len(a) > 2 else 0.0


def monge_elkan(x: list[str], y: list[str]) -> float:
    """Mean over the words of the shorter list of the best likeness in the other; 0 where one is empty."""
    if len(x) > len(y):
        x, y = y, x
    return sum(max(word_likeness(a, b) for b in y) for a in x) / len(x) if x else 0.0
