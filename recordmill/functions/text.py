"""Column functions on text: normalisers, hashes, grams, leaks, clocks and literals. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = r"[ \t\n\r]+"


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks, tabs and line ends as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def template_form(c: Column) -> Column:
    """Lower case with placeholders for long hexadecimal strings and numbers, blanks collapsed; equal templates have equal forms."""
    t = F.regexp_replace(F.lower(c), r"[0-9a-f]{16,}", "<hash>")
    t = F.regexp_replace(t, r"[0-9]+(\.[0-9]+)?", "<num>")
    return collapse_blanks(t)


def signature(*parts: Column) -> Column:
    """SHA-256 of parts joined by line feeds; nulls count as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hash_bucket(key: Column, n: int) -> Column:
    """A bucket below n from the first eight hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % n


def char_grams(c: Column, width: int, block: int = 1000) -> Column:
    """Distinct windows of width characters; a shorter text is one window. The text is cut into overlapping blocks first, since
    reaching a place in a long UTF-8 string takes time in proportion to it."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - width, F.lit(0)), F.lit(block)), lambda i: F.substring(c, i + 1, F.lit(block + width - 1)))
    grams = lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - width + 1, F.lit(1))), lambda j: F.substring(b, j, F.lit(width)))
    return F.array_distinct(F.flatten(F.transform(blocks, grams)))


def words(c: Column) -> Column:
    """The blank-delimited tokens of a text, lower-cased; none of an empty one."""
    return F.filter(F.split(collapse_blanks(F.lower(c)), " "), lambda w: w != "")


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def minutes_of(clock: Column) -> Column:
    """HH:MM as minutes after midnight; null where it's no clock."""
    h, m = F.regexp_extract(clock, r"^([0-9]{1,2}):([0-9]{2})$", 1), F.regexp_extract(clock, r"^([0-9]{1,2}):([0-9]{2})$", 2)
    return F.when(h != "", F.try_to_number(h, F.lit("99")).cast("int") * 60 + F.try_to_number(m, F.lit("99")).cast("int"))


def finite(c: Column, digits: int = 6) -> Column:
    """Null for NaN and infinities, else rounded half-even."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.bround(c, digits))


def decimal_form(c: Column) -> Column:
    """A decimal without trailing zeros, in fixed notation."""
    fixed = c.cast("decimal(18,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def leaks(target: Column, exposed: Column) -> Column:
    """Whether the target, lower-cased with underscores as blanks, stands in the exposed text."""
    plain = lambda x: collapse_blanks(F.translate(F.lower(x), "_", " "))
    return F.contains(plain(exposed), plain(target))


def masked(c: Column, name: str) -> Column:
    """A field's place holder, where the field is there."""
    return F.when(c.isNotNull(), F.lit(f"[MASKED_{name}]"))


def keywords_masked(c: Column, words: tuple[str, ...], mark: str = "[MASK]") -> Column:
    """A text with every listed word, in either case, replaced by a mark."""
    return F.regexp_replace(c, "(?i)" + "|".join(rf"\b{w}\b" for w in words), mark)


def ablations(fields: dict[str, Column], instruction: str, keywords: tuple[str, ...]) -> Column:
    """An array of (variant, text): the fields joined as they are, without the instruction, the instruction alone, each other field masked, and keywords masked."""
    line = lambda of: F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), c) for k, c in of.items()])
    rest = {k: c for k, c in fields.items() if k != instruction}
    made = {"full": line(fields), f"no_{instruction}": line(rest), f"{instruction}_only": line({instruction: fields[instruction]}), "keywords_masked": keywords_masked(line(fields), keywords)}
    made |= {f"mask_{k}": line({**fields, k: masked(c, k)}) for k, c in rest.items()}
    return F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("text")) for k, v in made.items()])
