"""Normalisation scalars as Column expressions.

Everything here stays inside the JVM. Two foldings have no built-in: Unicode compatibility (NFKC) and full case folding.
``normalize_text`` is right for texts that need neither; ``exact_text_columns`` sends only the rows that may need them through an
Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.vocabulary import DIMENSIONS

#: White space as Python's str knows it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
#: Characters that compatibility folding may change, or that join with their neighbours.
NEEDS_FOLDING = r"[^\x00-\xa0Ѐ-ѿ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends; empty: null."""
    return blank_to_null(F.trim(F.regexp_replace(c, SPACE, " ")))


def fold_case(c: Column | str) -> Column:
    """Lower case, ё to е, and what else ``normalize_text`` does but for white space."""
    c = F.lower(col(c))
    for old, new in (("ß", "ss"), ("ё", "е"), ("ς", "σ"), ("\xa0", " ")):  # each a search of bytes; translate looks at every character
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_text(c: Column | str) -> Column:
    """Lower case, ё to е, white space collapsed; empty: null."""
    return collapse(fold_case(c))


def fold_text(text: str) -> str:
    """NFKC and full case folding."""
    return unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(ArrayType(StringType()))
def _folded_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else fold_text(x) for x in xs], na_action="ignore")


def folded(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these texts folded by NFKC and case where that may matter: ``normalize_text`` of them is exact then.

    Rows pass as Arrow batches; a search in Arrow finds the texts with unusual characters, and only those are seen by Python. (A filter on
    many columns that keeps the other rows out of the way would be a constraint that Spark derives anew for every choice of the columns
    that a projection renames, 2 to the power of their number.)
    """
    at = [df.columns.index(c) for c in columns]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = list(b.columns)
            for i in at:
                odd = pc.match_substring_regex(arrays[i], NEEDS_FOLDING)
                if pc.any(odd).as_py():
                    texts = pc.filter(arrays[i], odd).to_pylist()
                    arrays[i] = pc.replace_with_mask(arrays[i], pc.fill_null(odd, False), pa.array(map(fold_text, texts), arrays[i].type))
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    return df.mapInArrow(fold, df.schema)


def plain_text(text: str) -> str | None:
    """What ``normalize_text`` makes of a folded text."""
    if text.isascii():  # folding is lower case there
        return " ".join(text.lower().split()) or None
    return " ".join(fold_text(text).replace("ё", "е").split()) or None


def _plain_compact(norm: str) -> str | None:
    for separator in " ./\\_-":  # a normalised text has no other white space
        norm = norm.replace(separator, "")
    return norm or None


def _plain_number(norm: str) -> float | None:
    found = re.search(NUMBER, norm.replace(",", "."), re.ASCII)
    return float(found[0]) if found else None


def _plain_pn(norm: str) -> float | None:
    n = _plain_number(norm)
    return n * 10 if n is not None and ("мпа" in norm or "mpa" in norm) else n


def _plain_length(norm: str) -> float | None:
    n = _plain_number(norm)
    if n is None:
        return None
    if "см" in norm or re.search(r"\bcm\b", norm):
        return n * 10
    return n * 1000 if norm.endswith(("m", "м")) and "мм" not in norm and not norm.endswith("mm") else n


def _plain_alias(dimension: str) -> Callable[[str], str | None]:
    words = DIMENSIONS[dimension]
    places, found = {w: i for i, w in enumerate(words)}, re.compile(rf"\b(?:{'|'.join(words)})\b").findall
    return lambda norm: words[min(ws, key=places.__getitem__)] if (ws := found(norm)) else norm


#: What a text of a mapping row becomes, said for one text: kind -> (result type, of the normalised text). The columns' forms are below.
PLAIN: dict[str, tuple[pa.DataType, Callable[[str], object]]] = {
    "text": (pa.string(), lambda norm: norm),
    "compact": (pa.string(), _plain_compact),
    "number": (pa.float64(), _plain_number),
    "pn": (pa.float64(), _plain_pn),
    "length": (pa.float64(), _plain_length),
    **{d: (pa.string(), _plain_alias(d)) for d in DIMENSIONS},
}


def coded_texts(texts: pa.Array) -> tuple[pa.Array, list[str | None]]:
    """Which of its different texts each text is, and those normalised."""
    d = texts.dictionary_encode()
    return d.indices, [None if t is None else plain_text(t) for t in d.dictionary.to_pylist()]


def typed_texts(coded: tuple[pa.Array, list[str | None]], kind: str) -> pa.Array:
    """What texts become by a kind of PLAIN."""
    type_, of = PLAIN[kind]
    return pa.array([None if t is None else of(t) for t in coded[1]], type_).take(coded[0])


def normalised(df: DataFrame, new: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, for each {name: (column, kind of PLAIN)}, what that text becomes.

    Rows pass as Arrow batches, of which every different text is normalised once: most columns of a catalogue hold few texts.
    """
    inputs = list(dict.fromkeys([*keep, *(c for c, _ in new.values())]))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{name}` {'double' if PLAIN[kind][0] == pa.float64() else 'string'}" for name, (_, kind) in new.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(i) for i, c in enumerate(inputs)}
            coded, out = {}, [columns[c] for c in keep]
            for c, kind in new.values():
                if c not in coded:
                    coded[c] = coded_texts(columns[c])
                out.append(typed_texts(coded[c], kind))
            yield pa.RecordBatch.from_arrays(out, [*keep, *new])

    return df.select(*inputs).mapInArrow(work, schema)


def fold_texts(texts: Column) -> Column:
    """An array of texts, folded. For tables of few rows, such as queries: all of them go through Python."""
    return _folded_all(texts)


def exact_text_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, for each {new: old}, the normalised text with NFKC and full case folding."""
    return folded(df.withColumns({new: F.col(old) for new, old in columns.items()}), list(columns)).withColumns({new: normalize_text(new) for new in columns})


def compact(norm: Column | str) -> Column:
    """A normalised article without separators; empty: null."""
    return blank_to_null(F.regexp_replace(col(norm), r"(?U)[\s\x1c-\x1f./\\_-]+", ""))


def normalize_article(c: Column | str) -> Column:
    """struct(raw, norm, compact)."""
    norm = normalize_text(c)
    return F.struct(col(c).alias("raw"), norm.alias("norm"), compact(norm).alias("compact"))


def from_alias(norm: Column, dimension: str) -> Column:
    """The canonical value of the first alias (in dictionary order) in a normalised text, else the text itself.

    One search finds all aliases of the text; the least of their places in the dictionary decides. No alias holds another as a word, so
    the search misses none.
    """
    words = DIMENSIONS[dimension]
    found = F.regexp_extract_all(norm, F.lit(rf"(?U)\b(?:{'|'.join(words)})\b"), F.lit(0))
    places = F.transform(found, lambda w: F.array_position(F.array(*map(F.lit, words)), w))
    first = F.array_min(places).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, words.values())), first - 1), norm)


def normalize_alias(c: Column | str, dimension: str) -> Column:
    return from_alias(normalize_text(c), dimension)


def _first_number(norm: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.replace(norm, F.lit(","), F.lit(".")), NUMBER, 0)).cast("double")


def dn_of(norm: Column) -> Column:
    return _first_number(norm)


def pn_bar_of(norm: Column) -> Column:
    n = _first_number(norm)
    return F.when(norm.contains("мпа") | norm.contains("mpa"), n * 10).otherwise(n)


def length_of(norm: Column) -> Column:
    n = _first_number(norm)
    metres = (norm.endswith("m") | norm.endswith("м")) & ~norm.contains("мм") & ~norm.endswith("mm")
    return F.when(norm.contains("см") | (norm.contains("cm") & norm.rlike(r"(?U)\bcm\b")), n * 10).when(metres, n * 1000).otherwise(n)


def normalize_dn(c: Column | str) -> Column:
    """The first signed decimal of a text (comma or dot)."""
    return dn_of(normalize_text(c))


def normalize_pn_bar(c: Column | str) -> Column:
    """As normalize_dn; ten times that if the text speaks of megapascals."""
    return pn_bar_of(normalize_text(c))


def normalize_length(c: Column | str) -> Column:
    """Millimetres: centimetres by ten, metres by a thousand."""
    return length_of(normalize_text(c))


def number_text(v: Column | str) -> Column:
    """A number as C's %g writes it: 80.0 is 80, 1.6 is 1.6; six significant digits, an exponent from a million on and below 0.0001.

    Digits that end in a five after the sixth are rounded up.
    """
    v = col(v)
    short = F.format_string("%.6g", v)  # Java keeps the zeros at the end of a fraction
    short = F.regexp_replace(F.regexp_replace(short, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    small = F.when((v == F.floor(v)) & (F.abs(v) < 100_000), F.floor(v).cast("string")).otherwise(F.when(v == 0, F.lit("0")).otherwise(short))
    return F.when(v.isNotNull(), small)


def distinct_parts(parts: list[Column] | Column) -> Column:
    """Text parts with white space collapsed, blanks and repeats dropped, in order."""
    arr = F.array(*parts) if isinstance(parts, list) else parts
    return F.array_distinct(F.filter(F.transform(arr, collapse), lambda x: x.isNotNull()))


def labelled(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix + value + suffix; null if the value is null or empty."""
    return F.when(value != "", F.concat(F.lit(prefix), value, F.lit(suffix)))


def title_brand(c: Column) -> Column:
    """Upper-case stays; else the first character is raised."""
    return F.when((F.upper(c) == c) & (F.lower(c) != c), c).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**30)))


def model_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")


def encoder_text(c: Column | str, model: str, role: str) -> Column:
    """The text that a model expects: e5 models want a role before it ('query' or 'passage'), once."""
    c, m = col(c), model.lower()
    if "multilingual-e5" not in m and not m.startswith("intfloat/e5"):
        return c
    done = c.startswith("query:") | c.startswith("passage:") | (c == "")
    return F.when(done, c).otherwise(F.concat(F.lit(f"{role}: "), c))


def tokens(norm: Column | str) -> Column:
    """Words of letters, digits and underscores; one tokenizer for documents and queries."""
    return F.regexp_extract_all(col(norm), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words(c: Column | str) -> Column:
    """The tokens of a text's normalised form; of a text without words and of null: none. White space is in no token, so it isn't collapsed."""
    return F.coalesce(tokens(fold_case(c)), F.array().cast("array<string>"))


def forms(texts: Column) -> Column:
    """Distinct normalised texts of an array, each with its separator-free form: array of struct(t, b)."""
    given = F.filter(F.array_distinct(F.transform(texts, normalize_text)), lambda x: x.isNotNull())
    return F.transform(given, lambda x: F.struct(x.alias("t"), F.coalesce(compact(x), F.replace(x, F.lit(" "), F.lit(""))).alias("b")))


def ladder(q: Column, s: Column) -> Column:
    """The exactness ladder of two forms: equal 1, prefix either way 0.85, inside either way 0.75, else 0. The separator-free
    forms are compared first, then the texts."""
    steps = F.when((q.b == s.b) | (q.t == s.t), F.lit(1.0))
    for x, y in ((q.b, s.b), (q.t, s.t)):
        steps = steps.when(x.startswith(y) | y.startswith(x), F.lit(0.85)).when(x.contains(y) | y.contains(x), F.lit(0.75))
    return steps.otherwise(F.lit(0.0))


def best_similarity(queries: Column, sources: Column) -> Column:
    """The best step over all pairs of two arrays of forms; null if either is empty."""
    return F.array_max(F.flatten(F.transform(queries, lambda a: F.transform(sources, lambda b: ladder(a, b)))))
