"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for salts, forms and units that are no part of a medication's name.
SALTS = ("xl", "xr", "er", "sr", "cr", "hcl", "sodium", "mg", "mcg", "unit", "units")


def slug(text: Column, size: int = 24) -> Column:
    """Lower-case letters and digits only, the first ``size``."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), 1, size)


def medication(text: Column) -> Column:
    """A medication's bare name: no brackets, strengths, salts or forms."""
    bare = F.regexp_replace(F.lower(text), r"\([^)]*\)", " ")
    bare = F.regexp_replace(bare, r"\b\d.*$", " ")
    bare = F.regexp_replace(bare, rf"\b({'|'.join(SALTS)})\b", " ")
    bare = F.regexp_replace(bare, r"[^a-z\s-]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def medication_aliases(text: Column) -> Column:
    """Names a medication goes by: those in brackets, then the main one; blank ones and repeats left out."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), 1), medication)
    return F.filter(F.array_distinct(F.concat(inner, F.array(medication(text)))), lambda x: x != "")


def named_in(note: Column, name: Column) -> Column:
    """Whether a note holds the first word of a medication's name, if that has three letters or more."""
    first = F.split(medication(name), " ")[0]
    return F.coalesce((F.length(first) >= 3) & F.lower(note).contains(first), F.lit(False))


def snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def cut_at_word(text: Column, size: int = 80, mark: str = "_") -> Column:
    """At most ``size`` characters, cut at the last ``mark`` within."""
    head = F.substring(text, 1, size)
    at_mark = F.regexp_replace(head, f"{mark}[^{mark}]*$", "")
    return F.when(F.length(text) <= size, text).when(at_mark != "", at_mark).otherwise(head)


def plain(markdown: Column) -> Column:
    """Without emphasis, code marks and link targets."""
    bare = F.regexp_replace(markdown, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(bare, r"[*_`~]+", ""))


def file_name(markdown: Column) -> Column:
    """File name from the first level-one header; null without one."""
    title = F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return F.when(title != "", F.concat(cut_at_word(snake(plain(title))), F.lit(".md")))


def collapse_punctuation(text: Column) -> Column:
    """Runs of ! and ? become their first mark, runs of one mark of , . ; : become one."""
    return F.regexp_replace(F.regexp_replace(text, r"([!?])[!?]+", "$1"), r"([,.;:])\1+", "$1")


def normalize_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and dots as plain ones."""
    return F.regexp_replace(F.translate(text, "‘’“”–—", "''\"\"--"), "…", "...")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}'-]+"), lambda w: w != "")


def searchable(text: Column) -> Column:
    """Punctuation but hyphens taken out, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))


def with_instruction(text: Column, instruction: str = "query: ") -> Column:
    """The instruction put before the text once."""
    return F.when(F.startswith(text, F.lit(instruction)), text).otherwise(F.concat(F.lit(instruction), text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def size_bucket(words: Column) -> Column:
    """short under 150 words, long over 400, else medium."""
    return F.when(words < 150, "short").when(words > 400, "long").otherwise("medium")


def token_estimate(text: Column) -> Column:
    """Tokens by a rule of thumb: four bytes of a word, two spaces or one special mark each."""
    special, space = F.regexp_count(text, F.lit(r"[^A-Za-z0-9\s]")), F.regexp_count(text, F.lit(r"\s"))
    return F.ceil((F.octet_length(text) - special - space) / 4 + space / 2 + special).cast("long")


def without_fences(text: Column) -> Column:
    """The inside of a fenced block, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*[ \t]*\n?", ""), r"\n?```$", ""))


def has_title(markdown: Column) -> Column:
    return markdown.rlike(r"(?m)^#[ \t]+\S")


def has_link(text: Column) -> Column:
    return text.rlike(r"\bhttps?://|\bwww\.|\]\(")


def numbers_in(text: Column) -> Column:
    """Number tokens, signs aside."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1)


def caps_ratio(text: Column) -> Column:
    """Share of capitals among ASCII letters; 0 without letters."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[A-Z]")).cast("double"), F.regexp_count(text, F.lit("[A-Za-z]")).cast("double")), F.lit(0.0))


def shouting(text: Column, start: float = 0.4, full: float = 0.7, letters: int = 4) -> Column:
    """0 up to a share of capitals of ``start``, 1 from ``full``, between them in proportion; 0 for fewer letters."""
    share = caps_ratio(text)
    return F.when(F.regexp_count(text, F.lit("[A-Za-z]")) < letters, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - start) / (full - start))))
