"""Name records of one person or organisation.

Every word of every name is hashed in MinHash bands over padded q-grams, words
that meet in a band and differ by a typing error gather in stars around the
frequent spelling. Names then gather in stars around the full names of one key
word: a name that leaves words out or shortens them joins the one star that all
its words agree with, and stays alone where several do. Each link from a name
to the center of its star is verified by Monge-Elkan similarity.

Stars are found by keyed lookups of (least, greatest) star per key, so no key
word, however common, is gathered in one task, and names of one key word are
never paired with one another to decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.linked import differing_pairs, index_of, latest_stores, lookup, message_records
from riskweave.llm.namegrammar import GIVEN, KNOWN, LINKS, NICKNAMES, describe, monge_elkan, name_words
from riskweave.llm.spellings import SHORTEST, choose_bands, deletion_keys, misspellings, stars, typing_errors, with_band_keys
from riskweave.runtime import Cuts, apart

#: Least Monge-Elkan similarity of a name and the center of its star.
VERIFIED = 0.7
RECALL = 0.92


def name_records(hub: DataFrame, cards: DataFrame) -> DataFrame:
    """rec, text: the name records of stores and messages; null texts are none."""
    out = latest_stores(hub, "NM_EC").select("rec", F.col("NM_EC").alias("text"))
    for prefix, column in (("PL:", "tx_oprc_nm_ptdr_pld"), ("NE:", "nm_ptdr_crto_ecommerce")):
        out = out.unionByName(message_records(cards, prefix, column))
    return out.where(F.col("text").isNotNull())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([name_words(x) for x in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["text", "n", "words"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for words, changes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            typed, others = {}, {}
            if changes:
                new = {c["pos"]: c["to"] for c in changes}
                typed = {c["to"][0]: words[c["pos"]] for c in changes if len(c["to"]) == 1}
                others = {c["to"][0]: c["others"] for c in changes if c["others"]}
                words = [x for i, w in enumerate(words) for x in new.get(i, [w])]
            got = (describe(words, typed) if words else None) or (None,) * 6
            out.append((*got, [got[1], *sorted(others[got[1]])] if got[1] in others else None))
        kind, key, first, second, firsts, third, keys = zip(*out, strict=True) if out else ((),) * 7
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), *[pa.array(c, pa.string()) for c in (kind, key, first, second, third)], *[pa.array(c, pa.list_(pa.string())) for c in (firsts, keys)]],
            names=["text", "n", "words", "kind", "key", "first", "second", "third", "firsts", "keys"],
        )


def run_ons(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """(w, parts) of the words that are two words whose blank was lost.

    Each part is a linking word, a known word or a word of five letters or
    more that the corpus holds at least as often; of several cuts the one whose
    rarer part is most frequent holds.
    """
    solid = lambda c: c.isin(sorted(KNOWN)) | (F.length(c) >= 5)
    link = lambda c: c.isin(sorted(LINKS))
    cut = words.where((F.length("w") >= 6) & ~F.col("w").isin(sorted(KNOWN))).select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    cut = cut.select("w", "n", F.expr("substring(w, 1, i)").alias("p"), F.expr("substring(w, i + 1)").alias("s"))
    cut = cut.where((link(F.col("p")) | solid(F.col("p"))) & (link(F.col("s")) | solid(F.col("s"))) & ~(link(F.col("p")) & link(F.col("s"))))
    v = vocabulary.where(solid(F.col("w")))
    for c in ("p", "s"):
        cut = cut.join(v.select(F.col("w").alias(c), F.col("n").alias(f"n{c}")), c, "left").where(link(F.col(c)) | (F.col(f"n{c}") >= F.col("n")))
    given = F.col("p").isin(sorted(GIVEN | set(NICKNAMES))) | F.col("s").isin(sorted(GIVEN | set(NICKNAMES))) | link(F.col("p")) | link(F.col("s"))
    weight = F.least(F.coalesce("np", "ns"), F.coalesce("ns", "np"))
    best = F.max(F.struct(given.alias("g"), weight.alias("m"), F.col("p"), F.col("s"))).alias("_b")
    return cut.groupBy("w").agg(best).select("w", F.filter(F.array("_b.p", "_b.s"), lambda x: ~x.isin(sorted(LINKS))).alias("parts"))


def described(records: DataFrame, cuts: Cuts) -> DataFrame:
    """text, n, words, kind, key, first, second, third, firsts, keys of each text that names somebody; keys are the candidates where the key word is a misspelling of several words alike."""
    texts = cuts.put(records.groupBy("text").agg(F.count(F.lit(1)).alias("n")).mapInArrow(_words, "text string, n long, words array<string>").where(F.col("words").isNotNull()))
    vocabulary = cuts.put(texts.select(F.explode("words").alias("w")).where(F.length("w") >= 2).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    bands, rows = choose_bands(vocabulary.count(), recall=RECALL)
    wrong = cuts.put(misspellings(vocabulary, cuts, lambda w: with_band_keys(w, bands, rows), typing_errors, KNOWN, 4.0))
    split = run_ons(vocabulary, vocabulary.join(wrong, "w", "left_anti"))
    changes = cuts.put(wrong.select("w", F.array("center").alias("parts"), "others").unionByName(split.withColumn("others", F.expr("cast(array() as array<string>)"))))
    open_words = texts.select("text", F.posexplode("words").alias("pos", "w")).where((F.length("w") >= 5) & ~F.col("w").isin(sorted(KNOWN)))
    changed = apart(open_words).join(changes, "w").groupBy("text").agg(F.collect_list(F.struct("pos", F.col("parts").alias("to"), "others")).alias("changes"))
    out = apart(texts).join(changed, "text", "left").select("text", "n", "words", "changes")
    return out.mapInArrow(_described, "text string, n long, words array<string>, kind string, key string, first string, second string, third string, firsts array<string>, keys array<string>").where(F.col("kind").isNotNull())


def with_key(p: DataFrame) -> DataFrame:
    """The names with one key word each.

    A key word that is a misspelling of several words alike becomes the one
    that other names with these initials (or this trade) have; where none or
    several do, the most frequent.
    """
    sure, open_ = p.where("keys is null"), p.where("keys is not null")
    first, second = F.when(F.col("kind") == "P", F.substring("first", 1, 1)), F.when(F.col("kind") == "P", F.substring("second", 1, 1)).otherwise(F.col("first"))
    at = lambda df: df.select("*", F.coalesce(first, F.lit("")).alias("_1"), second.alias("_2"))
    have = at(sure).groupBy("kind", "key", "_1").agg(F.collect_set("_2").alias("_have"), F.max(F.col("_2").isNull()).alias("_bare"))
    tried = at(open_).select("text", "kind", "_1", "_2", F.col("key").alias("_best"), F.explode("keys").alias("key")).transform(apart).join(have, ["kind", "key", "_1"], "left")
    score = F.when(F.col("_have").isNull(), 0).when(F.col("_2").isNull() | F.col("_bare") | F.array_contains("_have", F.col("_2")), 2).otherwise(1)
    chosen = tried.groupBy("text").agg(F.max(F.struct(score.alias("s"), (F.col("key") == F.col("_best")).alias("b"), "key")).alias("_t")).select("text", F.col("_t.key").alias("_key"))
    return sure.drop("keys").unionByName(open_.drop("keys").join(chosen, "text").withColumn("key", F.col("_key")).drop("_key"))


def _under(*parts) -> Column:
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _person_keys(g: Column) -> Column:
    """Keys that a person is found under: by middle words as typed and corrected, by their initial, by nothing more."""
    k, m, mc, ml = F.col("key"), F.col("m"), F.col("mc"), F.col("ml")
    return F.when(F.col("mfull"), F.array(_under(k, g, "M", m), _under(k, g, "M", mc), _under(k, g, "I", ml), _under(k, g, "*"))).when(ml.isNotNull(), F.array(_under(k, g, "J", ml), _under(k, g, "I", ml), _under(k, g, "*"))).otherwise(F.array(_under(k, g, "N"), _under(k, g, "*")))


def _person_looks(g: Column) -> Column:
    """Keys that a name with a shortened given word looks under."""
    k, m, mc, ml = F.col("key"), F.col("m"), F.col("mc"), F.col("ml")
    return F.when(F.col("mfull"), F.array(_under(k, g, "M", m), _under(k, g, "M", mc), _under(k, g, "J", ml), _under(k, g, "N"))).when(ml.isNotNull(), F.array(_under(k, g, "I", ml), _under(k, g, "N"))).otherwise(F.array(_under(k, g, "*")))


def _settle(forms: DataFrame, got: DataFrame, fresh: Column) -> DataFrame:
    """Adds ``e``: the one entity found, a fresh one where none was, null where several were; ``new`` marks fresh ones."""
    j = apart(forms).join(got, "fid", "left")
    return j.withColumn("e", F.when(F.col("lo").isNull(), fresh).when(F.col("lo") == F.col("hi"), F.col("lo"))).withColumn("new", F.col("lo").isNull()).drop("lo", "hi")


_FORM = ["fid", "key", "g", "gi", "firsts", "m", "mc", "ml", "mfull"]


def _one_middle(a: DataFrame, cuts: Cuts) -> DataFrame:
    """(e, to): persons of one key and given word whose middle words differ by a typing error, in stars.

    Candidates share the middle words less one letter, so no two persons meet by their key word alone.
    """
    n = a.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    m = a.where(F.length("m") >= SHORTEST).select("e", "key", "g", "m").distinct().transform(apart).join(n, "e")
    m = m.select("e", "n", "m", F.explode(F.transform(deletion_keys(F.col("m")), lambda h: F.concat_ws("|", "key", "g", h.cast("string")))).alias("k"))
    lo, hi = (m.select("k", *[F.col(c).alias(c + s) for c in ("e", "n", "m")]) for s in ("a", "b"))
    up = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("eb") > F.col("ea")))
    met = apart(lo).join(hi, "k").where(up & (F.col("ea") != F.col("eb"))).withColumn("d", typing_errors(F.col("ma"), F.col("mb"))).where(F.col("d").isNotNull())
    edges = cuts.put(met.select(F.col("ea").alias("a"), F.col("eb").alias("b"), "nb", "d").groupBy("a", "b").agg(F.max("nb").alias("nb"), F.min("d").alias("d")))
    return stars(a.select(F.col("e").alias("w")), edges, cuts).select(F.col("w").alias("e"), F.col("center").alias("to"))


def _full_persons(forms: DataFrame, cuts: Cuts) -> DataFrame:
    """Stars of names with one given word ``g``: full middle words, then their initials, then none.

    Each step is written, since the next ones read it several times and the
    driver holds the plan of all that is not.
    """
    g = F.col("g")
    a = forms.where("mfull").withColumn("e", _under(F.col("key"), g, F.col("mc"))).withColumn("new", F.lit(True))
    a = cuts.put(apart(a).join(_one_middle(a, cuts), "e", "left").withColumn("e", F.coalesce("to", "e")).drop("to").select(*forms.columns, "e", "new"))
    b = _settle(forms.where("ml is not null and not mfull"), lookup(forms.where("ml is not null and not mfull"), F.array(_under(F.col("key"), g, "I", F.col("ml"))), index_of(a, _person_keys(g))), _under(F.col("key"), g, F.concat("ml", F.lit("."))))
    ab = a.unionByName(cuts.put(b))
    none = forms.where("ml is null")
    c = _settle(none, lookup(none, F.array(_under(F.col("key"), g, "*")), index_of(ab.where("new"), _person_keys(g))), _under(F.col("key"), g, ""))
    return ab.unionByName(cuts.put(c))


def persons(p: DataFrame, cuts: Cuts) -> DataFrame:
    """fid, e of the persons' names.

    Names with a full given word make the stars; short forms and initials look
    among them; what finds none makes stars of its own.
    """
    f = p.where("kind = 'P'").select("fid", "key", "first", "second", "third", "firsts").distinct()
    f = f.select(
        "fid", "key", F.when(F.size("firsts") == 1, F.col("firsts")[0]).alias("g"), F.substring("first", 1, 1).alias("gi"), F.when(F.size("firsts") > 1, F.col("firsts")).alias("firsts"), F.col("second").alias("m"), F.col("third").alias("mc"),
        F.substring("second", 1, 1).alias("ml"), F.coalesce(F.length(F.split("second", " ")[0]) > 1, F.lit(False)).alias("mfull"), "first",
    )
    f = cuts.put(f)
    one = _full_persons(f.where("g is not null").select(_FORM), cuts)
    known = one.where("new")
    short = f.where("g is null")
    by_name = index_of(known, _person_keys(F.col("g")))
    by_initial = index_of(known, _person_keys(F.concat(F.substring("g", 1, 1), F.lit("."))))
    two = cuts.put(_settle(short, _short_looks(short, by_name, by_initial), F.lit(None).cast("string")))
    rest = two.where("new").withColumn("g", F.concat("first", F.lit("."))).select(_FORM)
    three = _full_persons(rest, cuts)
    return one.select("fid", "e").unionByName(two.where("not new").select("fid", "e")).unionByName(three.select("fid", "e"))


def _short_looks(short: DataFrame, by_name: DataFrame, by_initial: DataFrame) -> DataFrame:
    """fid, lo, hi for names with a short form (a look under each full name it may stand for) or an initial."""
    several = short.where("firsts is not null").withColumn("g", F.explode("firsts"))
    return lookup(several, _person_looks(F.col("g")), by_name).unionByName(lookup(short.where("firsts is null"), _person_looks(F.concat("gi", F.lit("."))), by_initial))


def organisations(p: DataFrame, cuts: Cuts) -> DataFrame:
    """fid, e of the organisations' names: trade and addition, then one of them, then neither."""
    k, t, a = F.col("key"), F.col("first"), F.col("second")
    f = cuts.put(p.where("kind = 'O'").select("fid", "key", "first", "second").distinct())
    emits = F.when(t.isNotNull() & a.isNotNull(), F.array(_under(k, t, "*"), _under(k, "*", a), _under(k, "*", "*"))).when(t.isNotNull(), F.array(_under(k, "*", "-"), _under(k, "*", "*"))).otherwise(F.array(_under(k, "*", "*")))
    name = _under(k, F.coalesce(t, F.lit("")), F.coalesce(a, F.lit("")))
    full = f.where(t.isNotNull() & a.isNotNull()).withColumn("e", name).withColumn("new", F.lit(True))
    x = f.where(t.isNotNull() & a.isNull())
    trade = cuts.put(_settle(x, lookup(x, F.array(_under(k, t, "*")), index_of(full, emits)), name))
    ft = full.unionByName(trade)
    x = f.where(t.isNull() & a.isNotNull())
    addition = cuts.put(_settle(x, lookup(x, F.array(_under(k, "*", a), _under(k, "*", "-")), index_of(ft.where("new"), emits)), name))
    fta = ft.unionByName(addition)
    x = f.where(t.isNull() & a.isNull())
    bare = _settle(x, lookup(x, F.array(_under(k, "*", "*")), index_of(fta.where("new"), emits)), name)
    return fta.unionByName(bare).select("fid", F.concat(F.lit("O|"), "e").alias("e"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [monge_elkan(x, y) >= VERIFIED for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["text", "e"])


def named_texts(records: DataFrame, cuts: Cuts) -> DataFrame:
    """text, e: the entity of each text; texts that name nobody or several are left out."""
    fid = F.concat_ws("|", "kind", "key", F.coalesce("first", F.lit("")), F.coalesce("second", F.lit("")), F.coalesce("third", F.lit("")))
    p = cuts.put(with_key(cuts.put(described(records, cuts))).withColumn("fid", fid))
    e = cuts.put(persons(p, cuts).unionByName(organisations(p, cuts)).where(F.col("e").isNotNull()))
    j = cuts.put(apart(p).join(e, "fid").select("text", "n", "words", "e"))
    center = j.groupBy("e").agg(F.max(F.struct(F.size("words").alias("s"), "n", "words")).alias("_c")).select("e", F.col("_c.words").alias("center"))
    return apart(j).join(center, "e").select("text", "e", "words", "center").mapInArrow(_verified, "text string, e string")


def same_name_pairs(hub: DataFrame, cards: DataFrame) -> DataFrame:
    """rec_a, rec_b: name records of one person or organisation with differing texts.

    Null texts are no records, placeholders name nobody, copies of one text
    are no pair; empty tables give no rows.
    """
    cuts = Cuts(hub.sparkSession, "names")
    records = cuts.put(name_records(hub, cards))
    return differing_pairs(records, cuts.put(named_texts(records, cuts)), "e", ["text"])
