"""Text cleaning and word splitting as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character a Unicode-aware ``\s`` matches, the plain space apart.
LATIN_SPACE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\x{a0}"
HIGH_SPACE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE = r"\x20" + LATIN_SPACE + HIGH_SPACE
URL_PATTERN = f"http[^{WHITESPACE}]+"
# A lone plain space is already normal, so only runs and other characters are rewritten. The
# outer range lets Java's matcher dismiss a letter with one comparison; this pattern runs over
# every character of the corpus.
_RARE = rf"[\x{{1680}}-\x{{3000}}&&[{HIGH_SPACE}]]"
SPACE_PATTERN = rf"[\x20{LATIN_SPACE}{_RARE}]{{2,}}|[{LATIN_SPACE}{_RARE}]"


def clean_text(text: Column) -> Column:
    """Remove URLs, collapse whitespace, trim; null becomes the empty string.

    The URL rule is a case-sensitive substring rule: ``httpd`` goes, ``HTTP://x`` stays.
    """
    no_url = F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, URL_PATTERN, ""))
    spaced = F.regexp_replace(F.coalesce(no_url, text), SPACE_PATTERN, " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def clean_papers(df: DataFrame, columns: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Clean each text column on its own; other columns pass through."""
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


def split_categories(categories: Column) -> Column:
    """Split on single spaces, keeping empty items; null gives an empty array."""
    return F.coalesce(F.split(categories, " "), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-cased space-separated words of cleaned text, in order, without empty ones."""
    return F.array_remove(F.split(F.lower(text), " "), "")


def paper_words(title: str = "title", abstract: str = "abstract") -> Column:
    """Words of the title followed by those of the abstract, both cleaned here."""
    both = F.concat_ws(" ", clean_text(F.col(title)), clean_text(F.col(abstract)))
    return words(both)
