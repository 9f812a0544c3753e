"""Address records that denote one location, matched top-down.

Levels: region (UF), locality (municipality), street, number; units inside a
number do not matter. Localities and street words are first brought to one
spelling (stars around the frequent spelling). Each written form of a street is
then linked within the candidates of the level above: a form that names its
postal code or locality within those, a form that names none inherits the
streets of that name in all localities. Where one candidate agrees, the form
takes it; where several do, they stay its explicit candidates and are decided
by the house number, or stay open.

Work is per written form of a street (its distinct words, not its records), and
forms meet candidates by street word, locality or postal code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.addresses import QUARTER_WORDS, address_parts
from riskweave.llm.linked import differing_pairs, latest_stores, message_records
from riskweave.llm.spellings import few_edits, misspellings, with_deletion_keys
from riskweave.runtime import Cuts, apart

_PLAIN = ("áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ", "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC")
FORM = ["text", "hint"]


def address_records(hub: DataFrame, cards: DataFrame) -> DataFrame:
    """rec, text, hint: the address records of stores and messages; hint is the store's municipality, else empty."""
    out = latest_stores(hub, "DC_ENDR", "NM_MNCP").select("rec", F.col("DC_ENDR").alias("text"), F.coalesce(F.upper(F.translate(F.trim("NM_MNCP"), *_PLAIN)), F.lit("")).alias("hint"))
    for prefix, column in (("PT:", "tx_endr_ptdr_ecommerce"), ("EN:", "tx_endr_enta_ecommerce")):
        out = out.unionByName(message_records(cards, prefix, column).withColumn("hint", F.lit("")))
    return out.where(F.col("text").isNotNull())


def _agree(a: Column, b: Column) -> Column:
    """Equal, or one of them not given."""
    return F.coalesce(a == b, F.lit(True))


def _given_agree(a: Column, b: Column) -> Column:
    """Given words agree: missing ones with anything, an initial with its word, typing errors allowed."""
    short = F.least(F.length(a), F.length(b))
    return F.coalesce((a == b) | ((short == 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))) | few_edits(a, b).isNotNull() | a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" "))), F.lit(True))


def parsed_forms(records: DataFrame, cuts: Cuts) -> DataFrame:
    """One row per text and hint that holds a street and a number: kind, title, given, street, number, cep, uf, places, marked."""
    p = records.select(*FORM).distinct().withColumn("_p", address_parts("text")).where(F.col("_p.number").isNotNull() & F.col("_p.street").isNotNull())
    given = F.nullif(F.regexp_replace(F.coalesce("_p.given", F.lit("")), r"\b(DE|DA|DO|DAS|DOS|E)\b\s*", ""), F.lit(""))
    return cuts.put(p.select(*FORM, *[F.col(f"_p.{c}").alias(c) for c in ("kind", "title", "street", "number", "cep", "uf", "places")], F.trim(given).alias("given"), F.col("_p.locality").alias("marked")))


def with_locality(forms: DataFrame, cuts: Cuts) -> DataFrame:
    """Adds ``loc`` and ``quarter``: places read as localities where the corpus names them so.

    A place is a locality when some spelling of it stands with a UF or as a
    store's municipality. Of several the one with the UF holds, else the last.
    """
    quarter = F.rlike("p", F.lit(r"^(" + "|".join(QUARTER_WORDS) + r")\b"))
    named = forms.select(*FORM, F.posexplode("places").alias("i", "p"), "marked")
    named = named.where((F.length("p") > 1) & ~quarter).select(*FORM, "i", "p", (F.col("p") == F.col("marked")).alias("sure"))
    hints = forms.where("hint <> ''").select(F.col("hint").alias("p"), F.lit(True).alias("sure"))
    seen = cuts.put(named.select("p", "sure").unionByName(hints).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("sure"), F.lit(False)).alias("sure")))
    wrong = misspellings(seen.select(F.col("p").alias("w"), "n"), cuts, with_deletion_keys, few_edits, rarer=4.0)
    center = apart(seen).join(wrong.select(F.col("w").alias("p"), "center"), "p", "left").withColumn("c", F.coalesce("center", "p"))
    localities = center.groupBy("c").agg(F.max("sure").alias("is_loc")).where("is_loc")
    known = cuts.put(apart(center).join(localities, "c").select("p", "c"))
    at = F.max(F.struct(F.coalesce("sure", F.lit(False)).alias("sure"), "i", "c")).alias("_l")
    loc = named.join(known, "p").groupBy(*FORM).agg(at).select(*FORM, F.col("_l.c").alias("own"))
    hint = known.select(F.col("p").alias("hint"), F.col("c").alias("store"))
    out = apart(forms).join(loc, FORM, "left").join(hint, "hint", "left").withColumn("loc", F.coalesce("own", "store"))
    return out.withColumn("quarter", F.get(F.filter("places", lambda p: p.rlike(r"^(" + "|".join(QUARTER_WORDS) + r"|VILA)\b")), 0)).drop("own", "store", "places", "marked")


STREET = ["name", "kind", "title", "given", "cep", "loc", "quarter"]


def streets(forms: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """(forms with ``sid``, candidates): sid names a written street, candidates is (sid, e), its streets; more than one where it stays ambiguous."""
    counts = forms.groupBy(F.col("street").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    wrong = misspellings(cuts.put(counts), cuts, with_deletion_keys, few_edits, rarer=4.0)
    f = apart(forms).join(wrong.select(F.col("w").alias("street"), "center"), "street", "left").withColumn("name", F.coalesce("center", "street")).drop("center", "street")
    sid = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in STREET])
    f = cuts.put(f.withColumn("sid", sid))
    s = cuts.put(f.groupBy("sid", *STREET).agg(F.count(F.lit(1)).alias("n")))

    # streets of a postal code: one per name, its words the most frequent ones given
    most = lambda c: F.mode(c, True)
    coded = s.where("cep is not null")
    e = coded.groupBy("cep", "name").agg(most("kind").alias("kind"), most("title").alias("title"), F.max(F.struct(F.length("given"), "given"))["given"].alias("given"), most("loc").alias("loc"), F.collect_set("quarter").alias("quarters"), F.sum("n").alias("n"))
    e = e.withColumn("e", F.concat_ws("|", "cep", "name"))
    # streets that no form gives a postal code for: the locality's forms of one name that agree with none of those
    placed = s.where("cep is null and loc is not null")
    x, y = F.col, lambda c: F.col(f"e_{c}")
    fits = _agree(x("kind"), y("kind")) & _agree(x("title"), y("title")) & _given_agree(x("given"), y("given"))
    renamed = lambda d, keep: d.select(*keep, *[F.col(c).alias(f"e_{c}") for c in ("e", "kind", "title", "given", "quarters", "n")])
    in_town = apart(placed).join(renamed(e.where("loc is not null"), ["name", "loc"]), ["name", "loc"]).where(fits)
    in_town = cuts.put(in_town.select("sid", F.col("e_e").alias("e"), F.array_contains("e_quarters", F.col("quarter")).alias("q")))
    alone = apart(placed).join(in_town.select("sid").distinct(), "sid", "left_anti")
    own = cuts.put(alone.groupBy("name", "loc", "kind", "title").agg(F.max(F.struct(F.length("given"), "given"))["given"].alias("given"), F.collect_set("quarter").alias("quarters"), F.sum("n").alias("n")))
    # a form that leaves kind or title out joins the fuller one, where it is one
    full = own.select("name", "loc", F.col("kind").alias("e_kind"), F.col("title").alias("e_title"))
    fuller = apart(own).join(full, ["name", "loc"]).where(_agree(F.col("kind"), F.col("e_kind")) & _agree(F.col("title"), F.col("e_title")) & (F.col("kind").isNull() | F.col("e_kind").isNotNull()) & (F.col("title").isNull() | F.col("e_title").isNotNull()))
    words = lambda k, t: F.concat_ws("|", "loc", "name", F.coalesce(k, F.lit("")), F.coalesce(t, F.lit("")))
    top = F.max(F.struct((F.col("e_kind").isNotNull().cast("int") + F.col("e_title").isNotNull().cast("int")).alias("s"), words(F.col("e_kind"), F.col("e_title")).alias("e"))).alias("_t")
    names = cuts.put(fuller.groupBy("name", "loc", "kind", "title").agg(top).select("name", "loc", "kind", "title", F.col("_t.e").alias("e")))
    same = [own[c].eqNullSafe(names[c]) for c in ("name", "loc", "kind", "title")]
    mine = apart(own).join(names, same).select(own["name"], own["loc"], own["kind"], own["title"], own["given"], own["quarters"], own["n"], names["e"])
    own_e = mine.groupBy("e", "name", "loc").agg(F.max("kind").alias("kind"), F.max("title").alias("title"), F.max(F.struct(F.length("given"), "given"))["given"].alias("given"), F.array_distinct(F.flatten(F.collect_list("quarters"))).alias("quarters"), F.sum("n").alias("n"))
    everything = cuts.put(e.select("e", "name", "loc", "kind", "title", "given", "quarters", "n").unionByName(own_e))

    c1 = coded.select("sid", F.concat_ws("|", "cep", "name").alias("e"), F.lit(None).cast("boolean").alias("q"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("name", "loc", "kind", "title")]
    c2 = apart(alone.alias("a")).join(names.alias("b"), same).select("a.sid", "b.e", F.lit(None).cast("boolean").alias("q"))
    loose = s.where("cep is null and loc is null")
    c3 = apart(loose).join(renamed(everything, ["name"]), "name").where(fits).select("sid", F.col("e_e").alias("e"), F.array_contains("e_quarters", F.col("quarter")).alias("q"))
    both = cuts.put(c1.unionByName(in_town).unionByName(c2).unionByName(c3))
    # a quarter that only some of the candidates have decides among them
    has = both.groupBy("sid").agg(F.coalesce(F.max("q"), F.lit(False)).alias("any"))
    return f, apart(both).join(has, "sid").where(~F.col("any") | F.coalesce("q", F.lit(False))).select("sid", "e")


def located(records: DataFrame, cuts: Cuts) -> DataFrame:
    """text, hint, location of the forms that denote one location.

    ``location`` is street and number. A form with several candidate streets
    takes the one where its number is known; with none or several it is left
    out, its candidates being no link.
    """
    f, c = streets(with_locality(parsed_forms(records, cuts), cuts), cuts)
    c = cuts.put(c)
    count = c.groupBy("sid").agg(F.count(F.lit(1)).alias("k"), F.min("e").alias("e"))
    j = cuts.put(f.select(*FORM, "sid", "name", "number").transform(apart).join(count, "sid"))
    sure = j.where("k = 1").select(*FORM, "name", "number", "e")
    # numbers known on the streets of a name; ambiguous forms meet those of their own number only
    known = sure.select("name", "number", "e").distinct()
    open_ = j.where("k > 1").select("sid", "name", "number").distinct()
    met = apart(apart(open_).join(known, ["name", "number"])).join(c, ["sid", "e"], "left_semi")
    one = met.groupBy("sid", "number").agg(F.min("e").alias("e"), F.max("e").alias("hi")).where("e = hi").drop("hi")
    decided = apart(j.where("k > 1").drop("e")).join(one, ["sid", "number"]).select(*FORM, "name", "number", "e")
    return sure.unionByName(decided).select(*FORM, F.concat_ws("|", "e", "number").alias("location"))


def same_location_pairs(hub: DataFrame, cards: DataFrame) -> DataFrame:
    """rec_a, rec_b: address records of one location with differing texts.

    Null texts are no records; placeholders and texts without street or number
    denote no location; copies of one text are no pair; empty tables give no rows.
    """
    cuts = Cuts(hub.sparkSession, "places")
    records = cuts.put(address_records(hub, cards))
    return differing_pairs(records, cuts.put(located(records, cuts)), "location", FORM)
