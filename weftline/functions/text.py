"""Name normalisation and dictionary-driven field extraction as built-in expressions.

Nulls stay null. Patterns are written for Java; letters of any script count as letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (canonical form, pattern of its spellings, sales unit, sold by weight or volume), in order of precedence.
FORMS = [
    ("Tablet", r"TABLETS?|TABS?", "Tablet", False),
    ("Capsule", r"CAPSULES?|CAPS?", "Capsule", False),
    ("Effervescent Tablet", r"EFFERVESCENT(?:\s+TAB(?:LET)?S?)?|EFF\s*TAB", "Tablet", False),
    ("Suppository", r"SUPPOSITOR(?:Y|IES)|SUPPS?", "Suppository", False),
    ("Ampoule", r"AMPOULES?|AMPS?", "Ampoule", False),
    ("Vial", r"VIALS?", "Vial", False),
    ("Injection", r"INJECTIONS?|INJ", "Injection", False),
    ("Patch", r"PATCH(?:ES)?", "Patch", False),
    ("Sachet", r"SACHETS?", "Sachet", False),
    ("Lozenge", r"LOZENGES?|LOZ", "Lozenge", False),
    ("Inhaler", r"INHALERS?", "Inhaler", False),
    ("Pen", r"PENS?", "Pen", False),
    ("Suspension", r"SUSPENSIONS?|SUSP", "Bottle", True),
    ("Syrup", r"SYRUPS?|SYR|SYP", "Bottle", True),
    ("Solution", r"SOLUTIONS?|SOL", "Bottle", True),
    ("Emulsion", r"EMULSIONS?", "Bottle", True),
    ("Drops", r"DROPS?", "Bottle", True),
    ("Cream", r"CREAMS?", "Tube", True),
    ("Ointment", r"OINTMENTS?|OINT", "Tube", True),
    ("Gel", r"GELS?", "Tube", True),
    ("Lotion", r"LOTIONS?", "Bottle", True),
    ("Foam", r"FOAM(?:L)?S?", "Can", True),
    ("Shampoo", r"SHAMPOO?S?", "Bottle", True),
    ("Mouthwash", r"MOUTHWASH(?:ES)?", "Bottle", True),
    ("Powder", r"POWDERS?|PWD", "Sachet", True),
    ("Spray", r"SPRAYS?", "Bottle", True),
]
#: Patterns of measured amounts, strengths and promotional noise (in order), and flavour words.
NUMBER = r"(\d+(?:\.\d+)?)"
MEASURED = r"(?i)" + NUMBER + r"\s*(?:ML|MLS|GM|GRAMS?|G|KG|L|LITT?ERS?)\b"
STRENGTH = r"(?i)\b\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)*\s*(?:MG|MCG|IU|MEQ|MMOL|%)(?:\s*/\s*\d+(?:[.,]\d+)?\s*(?:ML|MG|MCG|G|GM))?\b"
NOISE = [r"(?i)///\s*[A-Z0-9]+", r"(?i)\d+\s*%\s*OFF\b", r"(?i)\bFREE\s+GIFT\b", r"(?i)\bOFFER\b|\bOFR\b", r"(?i)\bNEW\b\s*$", r"\b\d+\s*\+\s*\d+\b"]
FLAVOURS = [
    "ORANGE", "STRAWBERRY", "MINT", "MENTHOL", "LEMON", "VANILLA", "CHOCOLATE", "GRAPE", "APPLE", "BANANA", "HONEY", "CITRUS", "TROPICAL", "BUBBLEGUM", "RASPBERRY",
    "PEACH", "CHERRY", "WATERMELON", "MIXED FRUIT", "PINEAPPLE", "MANGO", "CARAMEL", "COFFEE", "ANISE", "LICORICE", "SPEARMINT", "PEPPERMINT", "FRUIT", "BERRY",
]
PLACEHOLDERS = r"(?i)^(none|nan|n/?a|null|-|blank)?$"


def normalize_name(x: Column) -> Column:
    """Upper case, anything but letters, digits and _ to a space, spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def null_placeholders(x: Column) -> Column:
    trimmed = F.trim(x)
    return F.when(~trimmed.rlike(PLACEHOLDERS), trimmed)


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.regexp_replace(x, "^" + prefix, "")


def path_segment(x: Column, index: int, separator: str = ">") -> Column:
    """Trimmed segment (0-based) of a path, null where there is none."""
    return F.trim(F.get(F.split(x, separator), F.lit(index)))


def char_ngrams(x: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside space-padded words; a padded word no longer than n is one gram, once."""
    words = F.filter(F.split(F.lower(x), r"\s+"), lambda w: F.length(w) > 0)

    def of(word: Column, n: int) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        return F.when(size > n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: padded.substr(i, F.lit(n))))

    def grams(word: Column) -> Column:
        size = F.length(word) + 2
        parts = [F.coalesce(of(word, n), F.when((size == n) | ((size < n) & F.lit(n == low)), F.array(F.concat(F.lit(" "), word, F.lit(" ")))), F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(words, grams))


def word_ngrams(word: str, low: int = 2, high: int = 4) -> list[str]:
    """The grams that ``char_ngrams`` finds in one lower-case word, for use inside tasks."""
    padded = f" {word} "
    found = []
    for n in range(low, high + 1):
        if len(padded) > n:
            found += [padded[i : i + n] for i in range(len(padded) - n + 1)]
        elif len(padded) == n or n == low:
            found.append(padded)
    return found


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 0)), " ")


def _found(x: Column, pattern: Column | str, group: int = 1) -> tuple[Column, Column, Column]:
    """(position or 0, matched text, group) of a pattern's first match."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_instr(x, p), F.regexp_substr(x, p), F.regexp_extract(x, pattern, group) if isinstance(pattern, str) else F.lit(None)


def leftmost_form(x: Column) -> Column:
    """struct(at, order, form, unit, measured, text, amount, bare) of the leftmost dosage form, null where there is none.

    For each form a number in front of it is preferred to the bare word, wherever they stand; among forms the
    lowest position wins, then the order of the table.
    """
    hits = []
    for order, (name, spellings, unit, measured) in enumerate(FORMS):
        with_number, bare = rf"(?i){NUMBER}\s*(?:{spellings})\b", rf"(?i)\b(?:{spellings})\b"
        at_number, text_number, amount = _found(x, with_number)
        at_bare, text_bare, _ = _found(x, bare, 0)
        numbered = at_number > 0
        hits.append(F.struct(
            F.when(numbered, at_number).otherwise(at_bare).alias("at"), F.lit(order).alias("order"), F.lit(name).alias("form"), F.lit(unit).alias("unit"), F.lit(measured).alias("measured"),
            F.when(numbered, text_number).otherwise(text_bare).alias("text"), F.when(numbered, amount).alias("amount"), F.lit(bare).alias("bare"),
        ))
    return F.array_min(F.filter(F.array(*hits), lambda h: h["at"] > 0))


def cut_span(x: Column, at: Column, length: Column) -> Column:
    return F.trim(F.concat(F.substr(x, F.lit(1), at - 1), F.lit(" "), F.substr(x, at + length)))


def _cut_first(x: Column, pattern: Column) -> Column:
    at = F.regexp_instr(x, pattern)
    return F.when(at > 0, cut_span(x, at, F.length(F.regexp_substr(x, pattern)))).otherwise(x)


def extract_fields(df: DataFrame, column: str) -> DataFrame:
    """Adds trade_name, dosage_form, pack_size, unit_of_measure, flavour, confidence and needs_review.

    Noise goes first; then the leftmost dosage form is found and its pack size: for forms sold by weight or volume the
    first measured amount anywhere, else the number in front of the form or within six characters after it. These
    spans, strengths and the flavour are cut; the trade name is what is left. Null names give nulls.
    """
    clean = F.trim(F.col(column))
    for pattern in NOISE:
        clean = F.regexp_replace(clean, pattern, " ")
    df = df.withColumn("__x", clean).withColumn("__hit", leftmost_form(F.col("__x")))
    x, hit = F.col("__x"), F.col("__hit")
    size = F.length(hit["text"])
    measure_at, measure_text, measure = _found(x, MEASURED)
    tail = F.regexp_substr(F.substr(x, hit["at"] + size, F.lit(6)), F.lit(r"^\s*\d+(?:\.\d+)?"))
    by_measure = hit["measured"] & (measure_at > 0)
    by_tail = ~hit["measured"] & hit["amount"].isNull() & tail.isNotNull()
    pack = F.when(by_measure, measure).when(~hit["measured"], F.coalesce(hit["amount"], F.trim(tail)))
    again = lambda cut: _cut_first(cut, hit["bare"])
    cut = F.when(by_measure, again(cut_span(x, measure_at, F.length(measure_text)))).when(by_tail, again(cut_span(x, hit["at"], size + F.length(tail))))
    cut = cut.when(hit.isNotNull(), cut_span(x, hit["at"], size)).otherwise(x)
    df = df.withColumn("pack_size", pack).withColumn("__rest", F.regexp_replace(cut, STRENGTH, " "))
    words = r"(?i)\b(" + "|".join(FLAVOURS) + r")\b"
    df = df.withColumn("flavour", F.initcap(F.nullif(F.regexp_extract("__rest", words, 1), F.lit(""))))
    name = F.when(F.col("flavour").isNotNull(), _cut_first(F.col("__rest"), F.lit(words))).otherwise(F.col("__rest"))
    name = F.regexp_replace(F.regexp_replace(name, r"[\-/,]+\s*$|^\s*[\-/,]+", " "), r"\s+", " ")
    name = F.regexp_replace(name, r"^[ \-/,]+|[ \-/,]+$", "")
    df = df.withColumn("trade_name", F.nullif(name, F.lit("")))
    points = F.when(hit.isNotNull(), 4).otherwise(0) + F.when(F.col("pack_size").isNotNull(), 3).otherwise(0) + F.when(F.length("trade_name") >= 2, 3).otherwise(0)
    known = F.col(column).isNotNull()
    df = df.withColumn("dosage_form", hit["form"]).withColumn("unit_of_measure", hit["unit"])
    return df.withColumn("confidence", F.when(known, points / 10.0)).withColumn("needs_review", F.when(known, points < 7)).drop("__x", "__hit", "__rest")
