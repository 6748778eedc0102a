"""Functions on tables inside a row: rows as array<array<string>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of parameter codes and code cells, and the sizes of parts.
PARAMETER_CODE = r"^[A-Za-z]\d{3}(\(\d+\))?$"
CODE_CELL = r"^[A-Za-z]{1,2}\d{2,3}(\(\d+\))?$"
LEAST_CODES, PARAMETERS_A_PART, LEAST_CODED_ROWS, ROWS_A_CODE_PART, ROWS_A_PART, TOKENS_A_PART = 6, 4, 4, 3, 10, 500
# Patterns of units of specification tables.
UNIT_WORDS = r"(?i)\b(?:V|A|W|kW|Hz|rpm|mm|cm|m|kg|g|°C|bar|Pa|N|Nm|s|min|h|%)\b"


def cells(row: Column) -> Column:
    return F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit(""))))


def parameter_pairs(rows: Column) -> Column:
    """(name, code) of a grid: a code's name is the nearest cell before it that is not empty nor a code (O-25)."""

    def of_row(row: Column) -> Column:
        c = cells(row)
        named = F.transform(
            c,
            lambda x, i: F.struct(
                F.try_element_at(F.filter(F.slice(c, 1, i), lambda y: (y != "") & ~y.rlike(PARAMETER_CODE)), F.lit(-1)).alias("name"), F.when(x.rlike(PARAMETER_CODE), x).alias("code")
            ),
        )
        return F.filter(named, lambda p: p["code"].isNotNull() & p["name"].isNotNull())

    return F.flatten(F.transform(rows, of_row))


def is_index_table(rows: Column) -> Column:
    return F.size(parameter_pairs(rows)) >= LEAST_CODES


def data_rows(rows: Column) -> Column:
    return F.when(F.size(rows) > 1, F.slice(rows, 2, F.size(rows) - 1)).otherwise(rows)


def coded_row_ratio(rows: Column) -> Column:
    """Share of data rows whose first cell with content is a code (O-28); 0 without rows."""
    first = lambda r: F.try_element_at(F.filter(cells(r), lambda c: c != ""), F.lit(1))
    data = data_rows(rows)
    return F.coalesce(F.try_divide(F.size(F.filter(data, lambda r: F.coalesce(first(r).rlike(CODE_CELL), F.lit(False)))), F.size(data)), F.lit(0.0))


def is_code_table(rows: Column) -> Column:
    return (F.size(data_rows(rows)) >= LEAST_CODED_ROWS) & (coded_row_ratio(rows) >= 0.6)


def needs_split(rows: Column, markdown: Column) -> Column:
    """O-24."""
    long = F.length(F.coalesce(markdown, F.lit(""))) / 4 > TOKENS_A_PART
    return (F.size(rows) > 0) & (is_index_table(rows) | (is_code_table(rows) & (F.size(rows) - 1 > ROWS_A_CODE_PART)) | (F.size(rows) > ROWS_A_PART) | long)


def has_header(rows: Column) -> Column:
    """Whether the first of two rows or more is a header: it has letters, and the second is more digits than letters or not
    shorter (O-30)."""
    count = lambda row, kind: F.length(F.regexp_replace(F.array_join(row, " "), rf"(?U)[^{kind}]", ""))
    a, b = F.try_element_at(rows, F.lit(1)), F.try_element_at(rows, F.lit(2))
    return F.coalesce((F.size(rows) >= 2) & (count(a, r"\p{L}") > 0) & ((count(b, r"\d") > count(b, r"\p{L}")) | (F.size(a) <= F.size(b))), F.lit(False))


def markdown(rows: Column, header: Column | bool = True) -> Column:
    """O-31."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    first = F.try_element_at(rows, F.lit(1))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(first, lambda _: F.lit("---")), "|"), F.lit("|"))
    with_rule = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    header = F.lit(header) if isinstance(header, bool) else header
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(F.when(header, with_rule).otherwise(lines), "\n"))


def searchable(markdown_text: Column, rows: Column) -> Column:
    """Text of a table without pipes and dashes, then its cells, white space squeezed (O-33)."""
    flat = F.array_join(F.flatten(rows), " ")
    return F.trim(F.regexp_replace(F.concat_ws(" ", F.translate(markdown_text, "|-", "  "), flat), r"\s+", " "))


def empty_cells(rows: Column) -> Column:
    return F.size(F.filter(F.flatten(rows), lambda c: F.trim(c).isin("", "-", "N/A", "n/a")))


def bare_numbers(rows: Column) -> Column:
    """Cells that are a number and nothing else."""
    return F.size(F.filter(F.flatten(rows), lambda c: F.trim(c).rlike(r"^\d+\.?\d*$")))


def reconciled(markdown_text: Column, rows: Column) -> Column:
    """Rows with the header of the markdown before them, where their first row differs from it (O-34)."""
    head = F.transform(F.split(F.regexp_replace(F.split(F.trim(markdown_text), "\n")[0], r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    same = lambda r: F.transform(r, lambda c: F.lower(F.trim(c)))
    return F.when((F.size(rows) > 0) & (same(F.try_element_at(rows, F.lit(1))) == same(head)), rows).otherwise(F.concat(F.array(head), rows))


def nearby_table_names(texts: Column, longest: int = 200) -> Column:
    """Of the texts before a table the short ones that name it as a table or a specification (O-32)."""
    return F.filter(texts, lambda t: (F.length(t) < longest) & F.lower(t).rlike("tabla|especificaciones"))
