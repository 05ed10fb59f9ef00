"""Cleaning text columns and headers."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that stand for null (as spelled), and what characters become: spaces, invisible characters,
# quotes, dashes, and Cyrillic and Greek letters that look like Latin ones.
NULL_WORDS = ("nan", "None", "NAT", "NAN", "null")
REPLACED = {
    "\u00a0": ' ', "\u202f": ' ',
    "\u200b": '', "\u200c": '', "\u200d": '', "\u2060": '', "\ufeff": '', "\u180e": '',
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "‘": "'", "’": "'", "‛": "'",
    "–": '-', "—": '-', "―": '-',
    "…": '...',
    "А": 'A', "а": 'a', "В": 'B', "Е": 'E', "е": 'e', "К": 'K', "к": 'k', "М": 'M', "Н": 'H',
    "О": 'O', "о": 'o', "Р": 'P', "р": 'p', "С": 'C', "с": 'c', "Т": 'T', "Х": 'X', "х": 'x', "у": 'y',
    "Α": 'A', "α": 'a', "Β": 'B', "β": 'b', "Ε": 'E', "ε": 'e', "Η": 'H', "Ι": 'I', "ι": 'i', "Κ": 'K', "κ": 'k', "Ν": 'N',
    "ν": 'v', "Ο": 'O', "ο": 'o', "Ρ": 'P', "ρ": 'p', "Τ": 'T', "τ": 't', "Υ": 'Y', "υ": 'y', "Χ": 'X', "χ": 'x',
}

# All white space of Unicode, as a text's ends lose it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def default_map() -> dict[str, str]:
    return dict(REPLACED)


@dataclass(frozen=True)
class CleaningConfig:
    null_words: tuple[str, ...] = NULL_WORDS
    replace: dict[str, str] = field(default_factory=default_map)
    normal_form: str | None = "NFKC"
    controls: bool = True
    special: bool = False
    trim: bool = True
    lower_headers: bool = True


#: So many characters are held as Python strings at a time while texts are put into a normal form.
_HELD = 1 << 20


def _form(name: str):
    """An Arrow function; a nested one travels to the executors by value, which then need no package.

    Texts are taken out of Arrow's memory one by one and put back a little at a time: as Python strings a whole batch would
    take up to four bytes a character, once for what comes and once for what goes. What the parts took is given back, as
    workers live on.
    """

    @F.arrow_udf(T.StringType())
    def normal(texts: pa.Array) -> pa.Array:
        parts, some, size = [], [], 0
        for x in texts:
            text = x.as_py()
            some.append(None if text is None else unicodedata.normalize(name, text))
            size += len(some[-1] or "")
            if size >= _HELD:
                parts.append(pa.array(some, texts.type))
                some, size = [], 0
        out = pa.concat_arrays([*parts, pa.array(some, texts.type)])
        parts.clear()
        pa.default_memory_pool().release_unused()
        return out

    return normal


def _open(name: str) -> str:
    """A pattern for what a normal form may change. Latin-1 characters combine with none before them, so a text of those
    that stay as they are by themselves is in the form."""
    return r"[\x{100}-\x{10FFFF}" + "".join(c for c in map(chr, range(128, 256)) if unicodedata.normalize(name, c) != c) + "]"


def replaced(c: Column, by: dict[str, str]) -> Column:
    """One translate for characters that become one or none, a replace for each of the others."""
    single = {k: v for k, v in by.items() if len(k) == 1 and len(v) <= 1}
    keep, drop = [k for k, v in single.items() if v], [k for k, v in single.items() if not v]
    if single:
        # what has no counterpart at the end of the second string goes
        c = F.translate(c, "".join(keep + drop), "".join(single[k] for k in keep))
    for k, v in by.items():
        if k not in single:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def clean(c: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """A text column cleaned: null words, replacements, normal form, controls, special characters, white space.

    Everything but the normal form is a built-in expression; that one is an Arrow function which only texts that the form
    may change reach.
    """
    out = F.when(~c.isin(*config.null_words), c) if config.null_words else c
    # as many bytes as characters: nothing beyond ASCII, which the map (but for keys of one's own) and the form leave alone
    beyond = F.octet_length(out) > F.length(out)
    new = replaced(out, config.replace)
    if config.normal_form:
        new = F.coalesce(_form(config.normal_form)(F.when(beyond & F.rlike(new, F.lit(_open(config.normal_form))), new)), new)
    plain = {k: v for k, v in config.replace.items() if k.isascii()}
    out = F.when(beyond, new).otherwise(replaced(out, plain))
    if config.controls:
        out = F.regexp_replace(out, _CONTROLS, "")
    if config.special:
        out = F.regexp_replace(out, r"(?U)[^\w\s]", "")
    if config.trim:
        out = F.btrim(out, F.lit(WHITE))
    return out


def clean_header(name: str, config: CleaningConfig = CleaningConfig()) -> str:
    for k, v in config.replace.items():
        name = name.replace(k, v)
    name = unicodedata.normalize("NFKC", name)
    if config.lower_headers:
        name = name.lower()
    return re.sub("__+", "_", re.sub("[^A-Za-z0-9_]", "_", name)).strip("_")


def unique_names(names: list[str], empty: str = "col_{}") -> list[str]:
    """Names without clashes (whatever their case): a number is put behind the later ones."""
    taken: set[str] = set()
    out = []
    for k, name in enumerate(names, 1):
        base = own = name or empty.format(k)
        n = 0
        while own.lower() in taken:
            n += 1
            own = f"{base}_{n}"
        taken.add(own.lower())
        out.append(own)
    return out


def clean_headers(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    return df.toDF(*unique_names([clean_header(c, config) for c in df.columns]))


def clean_frame(df: DataFrame, config: CleaningConfig = CleaningConfig(), columns: list[str] | None = None) -> DataFrame:
    """Headers and text columns (or those named, by their clean names) cleaned in one projection."""
    df = clean_headers(df, config)
    chosen = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: clean(F.col(f"`{c}`"), config) for c in chosen})


def quick_clean(df: DataFrame) -> DataFrame:
    return clean_frame(df, CleaningConfig(lower_headers=False))
