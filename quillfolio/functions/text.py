"""Company names, file names and markup, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clean_cell

# Words that differ between two spellings of one company name.
NAME_NOISE = ["limited", "ltd", "plc", "company", "co", "the", "inc"]

# Fixed pattern: words in a price file's name that are not part of the company's.
FILE_NOISE = r"(?i)\b(stock|shares?|prices?|history|historical|data|daily|export|download|csv|of|the)\b"

# Entities resolved in a table cell; any other becomes a blank.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'"}


def name_tokens(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9 ]+", " "), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(NAME_NOISE))


def company_from_file(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"(?i)\.[a-z0-9]+$", "")
    stem = F.regexp_replace(stem, r"\(\d+\)", "")
    stem = F.regexp_replace(stem, r"[_+-]+", " ")
    stem = F.regexp_replace(stem, FILE_NOISE, " ")
    return F.trim(F.regexp_replace(stem, r"\s+", " "))


def cell_text(html: Column) -> Column:
    """Text of one table cell: tags out, entities resolved, blanks collapsed."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    text = bare
    for entity, plain in ENTITIES.items():
        text = F.regexp_replace(text, "(?i)" + entity, plain)
    # An ampersand is resolved last, so its result is not read as an entity again.
    text = F.regexp_replace(text, r"(?i)&(?!amp;)([a-z]+|#x?[0-9a-f]+);", " ")
    text = F.regexp_replace(text, "(?i)&amp;", "&")
    return clean_cell(F.regexp_replace(F.when(bare.contains("&"), text).otherwise(bare), r"\s+", " "))


def html_rows(html: Column) -> Column:
    """array(table) of array(row) of array(cell text)."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)(<table.*?</table>)"), 1)
    return F.transform(
        tables,
        lambda t: F.transform(
            F.regexp_extract_all(t, F.lit(r"(?is)(<tr.*?</tr>)"), 1),
            lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)(<t[dh].*?</t[dh]>)"), 1), cell_text),
        ),
    )


def join_wrapped(parts: Column) -> Column:
    """One text from wrapped lines; a long unbroken piece was cut mid-word."""
    def add(acc: Column, part: Column) -> Column:
        cut = (acc["n"] > 1) & (F.length(acc["last"]) >= 9) & ~acc["last"].contains(" ")
        text = F.when(acc["n"] == 0, part).otherwise(F.concat(acc["text"], F.when(cut, "").otherwise(" "), part))
        return F.struct((acc["n"] + 1).alias("n"), part.alias("last"), text.alias("text"))

    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("last"), F.lit("").alias("text"))
    return F.aggregate(parts, start, add, lambda acc: acc["text"])


def trading_code(parts: Column) -> Column:
    """The trading code split over wrapped lines, or null if it is not one."""
    joined = F.array_join(parts, "")
    return F.when(joined.rlike(r"^[A-Z0-9][A-Z0-9&\-.]{1,19}$"), joined)


def masked(account_number: Column) -> Column:
    return F.concat(F.lit("…"), F.right(account_number, F.lit(4)))


def delimiter_of(heading: Column) -> Column:
    """The most frequent of comma, tab and semicolon; comma when there is none."""
    def count(ch: str) -> Column:
        return F.length(heading) - F.length(F.replace(heading, F.lit(ch), F.lit("")))

    comma, tab, semi = count(","), count("\t"), count(";")
    return (
        F.when((comma >= tab) & (comma >= semi), ",").when(tab >= semi, "\t").otherwise(";")
    )


def split_cells(line: Column, delimiter: str) -> Column:
    """Cells of one delimited line; quoted cells keep delimiters, "" is a quote."""
    pieces = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(delimiter + r'((?:"(?:[^"]|"")*"|[^"' + delimiter + r"])*)"), 1)
    return F.transform(
        pieces,
        lambda c: F.when(c.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_extract(c, r'(?s)^\s*"(.*)"\s*$', 1), F.lit('""'), F.lit('"'))).otherwise(c),
    )
