"""Column functions that read fields from recognised text, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What trim() strips and \s matches in the patterns' own dialect, for Java's regular expressions.
SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Words of header and advice blocks.
BOILERPLATE = ("government", "proof", "identity", "citizenship", "verification", "authentication", "scanning")
_DATE = r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once, however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), 0)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later steps may use many times: a generator stands between, so that the optimizer doesn't copy the expression into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def trimmed_column(text: Column) -> Column:
    """trimmed, of a column that costs nothing to read: most texts have nothing to trim, and a search is far cheaper than a replacement."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(SPACE), trimmed(text)).otherwise(text)


def if_plain(text: Column, plain: Column, other: Column) -> Column:
    """`plain` for texts of printable ASCII alone, in which a blank is the only space: Java tests SPACE by a chain of a dozen predicates a letter."""
    return F.when(text.rlike("[^ -~]"), other).otherwise(plain)


def words(text: Column) -> Column:
    """The words of a text; empty ones are left out."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, counted without cutting it up (which compiles the pattern anew for every text)."""
    return if_plain(text, F.regexp_count(text, F.lit("[^ ]+")), F.regexp_count(text, F.lit(f"[^{SPACE[1:]}+")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one (or if the group is empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: The words, with what doesn't count between their letters.
_BOILER = f"(?=[{''.join(sorted({w[0] for w in BOILERPLATE}))}])(?:" + "|".join(r"[^A-Za-z0-9_\s]*".join(w) for w in BOILERPLATE) + ")"


def is_boilerplate(text: Column) -> Column:
    """Whether a text has one of the words when all but letters, digits, underscores and spaces is left out."""
    return F.coalesce(F.lower(text).rlike(_BOILER), F.lit(False))


def extract_dob(text: Column) -> Column:
    """The date behind "dob", else behind "date ... birth", else any date unless the text says "issued"."""
    free = F.when(~F.contains(F.lower(text), F.lit("issued")), _first(text, rf"\b{_DATE}\b"))
    return F.coalesce(_first(text, rf"(?i)dob[:\s]*{_DATE}"), _first(text, rf"(?i)date[^:]*birth[:\s]*{_DATE}"), free)


_NAME_WORD = "[A-Z][A-Za-z]{1,14}"


def extract_name(text: Column) -> Column:
    """The first line that begins with two to four capitalised words; the whole line if it is nothing else, else its first two, three or four words."""

    def of_line(line: Column) -> Column:
        line = trimmed(line)
        w = F.split(line, f"{SPACE}+")
        whole = F.when(F.array_join(w, " ").rlike(rf"^{_NAME_WORD}( {_NAME_WORD}){{1,3}}$"), line)
        lead = F.nullif(F.regexp_extract(F.array_join(w, " "), rf"^({_NAME_WORD} {_NAME_WORD})(?: |$)", 1), F.lit(""))
        return F.coalesce(whole, lead)

    names = F.filter(F.transform(F.split(text, "\n"), of_line), lambda n: n.isNotNull())
    # Only a text with a line that begins with two such words is taken apart.
    return F.when(text.rlike(rf"(?:^|\n){SPACE}*{_NAME_WORD}{SPACE}+{_NAME_WORD}"), F.get(names, 0))


def extract_gender(text: Column) -> Column:
    return F.initcap(F.lower(_first(text, r"(?i)\b(male|female|transgender)\b")))


def extract_id_number(text: Column) -> Column:
    return _first(text, rf"\b(\d{{4}}{SPACE}*\d{{4}}{SPACE}*\d{{4}})\b")


FIELDS = {"name": extract_name, "date_of_birth": extract_dob, "gender": extract_gender, "id_number": extract_id_number}
