"""Fill-in-the-middle: a text is cut at two token bounds, and its parts are put into another order behind markers.

Tokens are runs of ASCII letters, or any other single character. A delimiter, escaped in the text first, is injected after each token;
counting delimiters counts tokens, and substring_index takes the tokens before or after a number of them. The parts then lose the
delimiters and the escapes. Form and bounds come from a digest of the document's id, so reruns and other layouts agree.

Plan: one pass of JVM expressions, without exchange. The marked text is a column of its own, which all cuts read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import clear_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, how many are transformed, and how many of those have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

# The delimiter, and the escape that stands for it and for itself. Escapes are tokens of two characters, none of which is a letter.
DELIMITER, ESCAPE = "\x1e", "\x1f"
_UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _first(marked: Column, n: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(DELIMITER), n.cast("int"))


def _part(cut: Column) -> Column:
    """Tokens with their delimiters as text again."""
    return unescaped(F.replace(cut, F.lit(DELIMITER), F.lit("")))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """What a model is trained on; null for a plain text, which stays as it is."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from output and form alone. Transformed texts hold no marker, so each is found at its first place."""
    after = lambda mark: F.substr(output, F.locate(mark, output) + F.lit(len(mark)))
    upto = lambda part, mark: F.substring_index(part, mark, 1)
    psm = F.concat(upto(after(PREFIX), SUFFIX), after(MIDDLE), upto(after(SUFFIX), MIDDLE))
    spm = F.concat(upto(after(PREFIX), MIDDLE), after(MIDDLE), upto(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns ``keep``, the number n of tokens, form (plain, psm, spm), prefix, middle and suffix (null if plain) and output.

    Texts that are empty or hold a marker stay plain. Null text: empty; null ids: as if empty. Repeated rows get the same result
    each; an empty table gives an empty result. A kept column whose name is a result's gets underscores at its end.
    """
    names = clear_of(list(keep), ["n", "form", "prefix", "middle", "suffix", "output"])
    kept = {c: f"__k{i}" for i, c in enumerate(keep)}
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))), 256)
    rows = docs.select(*(docs[c].alias(k) for c, k in kept.items()), F.coalesce(docs[text], F.lit("")).alias("body"), digest.alias("digest"))
    rows = rows.select("*", F.regexp_replace(escaped(F.col("body")), _UNIT, "$0" + DELIMITER).alias("marked"))
    h = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.select("*", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long").alias("n"))
    cut = [F.pmod(x, F.col("n") + 1) for x in h[:2]]
    plain = (F.col("n") == 0) | (F.pmod(h[2], F.lit(100)) >= transformed)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains("body", F.lit(mark))
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < suffix_first, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), F.least(*cut).alias("a"), F.greatest(*cut).alias("b"))
    a, b, n, marked = (F.col(c) for c in ("a", "b", "n", "marked"))
    # the marked text ends in a delimiter; a count beyond those that there are gives the whole
    parts = {"prefix": _first(marked, a), "middle": _first(_first(marked, b), a - b), "suffix": _first(marked, b - n - 1)}
    rows = rows.select(*kept.values(), "body", "n", "form", *(F.when(F.col("form") != "plain", _part(p)).alias(c) for c, p in parts.items()))
    output = F.coalesce(assembled(*(F.col(c) for c in ("form", "prefix", "middle", "suffix"))), F.col("body"))
    return rows.select(*(F.col(k).alias(names[c]) for c, k in kept.items()), "n", "form", "prefix", "middle", "suffix", output.alias("output"))
