"""Tax-document functions: check digits, standard form, root (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.expr import let


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^0-9]", "")


def _digit(d: Column, i: Column) -> Column:
    return F.ascii(F.substring(d, i, F.lit(1))) - 48


def _check(d: Column, n: int, cycle: int) -> Column:
    """Check digit over the first n digits; weights run 2, 3, ... from the right and start again after ``cycle`` of them."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + _digit(d, i) * ((F.lit(n) - i) % cycle + 2))
    return let(total % 11, lambda r: F.when(r < 2, 0).otherwise(11 - r))


def _closes(d: Column, n: int, cycle: int) -> Column:
    return (_check(d, n, cycle) == _digit(d, F.lit(n + 1))) & (_check(d, n + 1, cycle) == _digit(d, F.lit(n + 2)))


def valid_document(doc: Column) -> Column:
    """Check digits of an 11- or 14-digit string; other lengths are false. All-equal 11 digits are false."""
    return let(
        doc,
        lambda d: F.coalesce(
            F.when(F.length(d) == 11, (d != F.repeat(F.substring(d, 1, 1), F.lit(11))) & _closes(d, 9, 10)).when(F.length(d) == 14, _closes(d, 12, 8)),
            F.lit(False),
        ),
    )


def _left_zeros(d: Column, n: int) -> Column:
    """Pads only: ``lpad`` alone would cut longer strings."""
    return F.when(F.length(d) < n, F.lpad(d, n, "0")).otherwise(d)


def standard_document(c: Column) -> Column:
    """struct<doc, person, valid>: of the padded candidates the first valid, else the first.

    Up to 11 digits the 11-digit form is tried before the 14-digit one; longer
    ones are padded to 14. No digits, or null, gives nulls throughout.
    """

    def choose(d: Column) -> Column:
        d11, d14 = _left_zeros(d, 11), _left_zeros(d, 14)
        short = F.length(d) <= 11
        return F.when(short & valid_document(d11), d11).when(valid_document(d14), d14).when(short, d11).otherwise(d14)

    def describe(doc: Column) -> Column:
        known = doc.isNotNull()
        return F.struct(doc.alias("doc"), F.when(known, F.when(F.length(doc) == 11, "PF").otherwise("PJ")).alias("person"), F.when(known, valid_document(doc)).alias("valid"))

    return let(let(F.nullif(digits(c), F.lit("")), choose), describe)


def known_document(c: Column) -> Column:
    """The standard digits of a document whose check digits hold, else null.

    Repeated digits of either length are placeholders and give null too.
    """

    def choose(d: Column) -> Column:
        bare = F.regexp_replace(d, "^0+", "")
        d11, d14 = F.lpad(bare, 11, "0"), F.lpad(bare, 14, "0")
        return (
            F.when(d.rlike(r"^(\d)\1*$") | (bare == ""), None)
            .when(F.length(d).between(12, 14) & valid_document(d14), d14)
            .when((F.length(bare) <= 11) & valid_document(d11), d11)
            .when((F.length(bare) <= 14) & valid_document(d14), d14)
        )

    return let(F.nullif(digits(c), F.lit("")), choose)


def tax_root(doc: Column) -> Column:
    """First eight digits of a company's document; a person's whole document."""
    return F.when(F.length(doc) == 14, F.substring(doc, 1, 8)).otherwise(doc)
