"""Fill-in-the-middle by escaped marker injection.

A text is cut into units (code points, words or lines) without user functions: a delimiter is escaped in the text,
regexp_replace sets one after every unit, their number is the number of units, and substring_index takes the parts that lie
between the ranks of two cuts. Parts are freed of delimiters, unescaped and put together with markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, named, unused

#: Set after each unit, and what stands before a stand-in: ESCAPE 0 is ESCAPE, ESCAPE 1 is DELIMITER.
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Patterns that cover any escaped text without gaps; none begins within an escape.
UNITS = {
    "char": rf"{ESCAPE}[01]|[^{ESCAPE}]",
    "word": r"\s*\S+|\s+\z",
    "line": r"[^\n]*\n|[^\n]+\z",
}

PLAIN_FROM, SPM_BELOW = 90, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(DELIMITER), F.lit(f"{ESCAPE}1"))


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was; the order of the stand-ins doesn't matter, since each begins with ESCAPE."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}1"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def index(text: Column, count: Column) -> Column:
    """substring_index by DELIMITER, the count being a column."""
    return F.call_function("substring_index", text, F.lit(DELIMITER), count)


def draws(key: Column, seed: int) -> list[Column]:
    """The first four unsigned 32-bit numbers of sha256 of 'seed:key', a null key being the text null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infilled(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "char", seed: int = 1) -> DataFrame:
    """df with fim_n (units), fim_form (plain, psm or spm), fim_prefix, fim_middle, fim_suffix (null: plain) and fim_output.

    The two cuts, the form and the order come from a hash of the key, so that reruns agree and rows of one key are cut alike
    by rank. Null texts count as empty. A text that is empty or holds a marker is plain, and so are
    those whose draw of 100 is PLAIN_FROM or more. A null key is hashed as 'null'; ties and repeated rows each give their row; an
    empty table gives none. Columns of df of those names are replaced, all others are kept as they are.
    """
    body, marked, n, a, b, form = (unused(df, c) for c in ("body", "marked", "n", "cut_a", "cut_b", "form"))
    h = draws(named(key), seed)
    keep = [c for c in columns_of(df.drop("fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output"))]
    rows = df.withColumn(body, F.coalesce(named(text), F.lit("")))
    rows = rows.withColumn(marked, F.regexp_replace(escaped(F.col(body)), UNITS[unit], f"$0{DELIMITER}"))
    rows = rows.withColumn(n, (F.octet_length(marked) - F.octet_length(F.replace(F.col(marked), F.lit(DELIMITER), F.lit("")))).cast("long"))
    first, second = F.pmod(h[0], F.col(n) + 1), F.pmod(h[1], F.col(n) + 1)
    rows = rows.withColumns({a: F.least(first, second).cast("int"), b: F.greatest(first, second).cast("int")})
    plain = (F.col(body) == "") | F.contains(F.col(body), F.lit(PREFIX)) | F.contains(F.col(body), F.lit(SUFFIX)) | F.contains(F.col(body), F.lit(MIDDLE)) | (h[2] % 100 >= PLAIN_FROM)
    rows = rows.withColumn(form, F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm"))
    cut = F.col(form) != "plain"
    head = index(F.col(marked), F.col(b))
    parts = {
        "fim_prefix": F.when(cut, unescaped(index(head, F.col(a)))),
        "fim_middle": F.when(cut, unescaped(index(head, F.col(a) - F.col(b)))),
        # the empty part after the last delimiter counts as one
        "fim_suffix": F.when(cut, unescaped(index(F.col(marked), F.col(b) - F.col(n).cast("int") - 1))),
    }
    rows = rows.select(*keep, F.col(body), F.col(n).alias("fim_n"), F.col(form).alias("fim_form"), *(c.alias(k) for k, c in parts.items()))
    psm = F.concat(F.lit(PREFIX), "fim_prefix", F.lit(SUFFIX), "fim_suffix", F.lit(MIDDLE), "fim_middle")
    spm = F.concat(F.lit(SUFFIX), "fim_suffix", F.lit(PREFIX), "fim_prefix", F.lit(MIDDLE), "fim_middle")
    output = F.when(F.col("fim_form") == "psm", psm).when(F.col("fim_form") == "spm", spm).otherwise(F.col(body))
    return rows.withColumn("fim_output", output).drop(body)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from: each marker is there once, so what lies between is exact."""
    before = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    after = lambda text, marker: F.substring_index(text, marker, -1)
    psm = F.concat(after(F.substring_index(before, SUFFIX, 1), PREFIX), middle, after(before, SUFFIX))
    spm = F.concat(after(before, PREFIX), middle, after(F.substring_index(before, PREFIX, 1), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
