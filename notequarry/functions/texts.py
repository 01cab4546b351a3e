"""Text functions: keys, slugs, clipping, tokens."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def note_key(path: Column) -> Column:
    return F.concat(F.lit("note:"), path)


def node_key(label: Column) -> Column:
    return F.concat(F.lit("node:"), label)


def chunk_ref(path: Column, header: Column) -> Column:
    return F.concat_ws("#", path, header)


def embed_text(header: Column, text: Column) -> Column:
    """The text below its header, if it has one; null without a text."""
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.concat(header, F.lit("\n"), text))


def slug(text: str) -> str:
    """Letters without their accents, in lower case, joined by single hyphens; other signs go."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[-\s]+", "-", re.sub(r"[^a-z0-9\s-]", "", plain)).strip("-")


@F.pandas_udf(StringType())
def slugify(texts: pd.Series) -> pd.Series:
    return texts.map(slug, na_action="ignore")


#: Letters that case folding takes together beside lower case, as full-text indexes do.
FOLDED, FOLDED_TO = "µſςϐϑϕϖϰϱϵ", "μsσβθφπκρε"


@lru_cache(maxsize=1)
def accents() -> tuple[str, str, str]:
    """Latin letters with one accent, what stays of each without, and the accents: made from Unicode's decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, d) for c, d in pairs if len(d) == 2 and d[0].isascii() and d[0].isalpha()]
    return "".join(c for c, _ in pairs), "".join(d[0] for _, d in pairs), "".join(sorted({d[1] for _, d in pairs}))


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their accent; accents that stand by themselves go."""
    letters, plain, marks = accents()
    return F.translate(F.lower(F.translate(text, letters + marks, plain)), FOLDED, FOLDED_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """What tokens() gives, of a string in the driver."""
    letters, plain, marks = accents()
    gone = str.maketrans(letters, plain, marks)
    return re.findall(r"[^\W_]+", text.translate(gone).lower().translate(str.maketrans(FOLDED, FOLDED_TO)))


def words(text: Column) -> Column:
    """What white space divides, lower-cased and distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def clip_text(text: Column, n: int) -> Column:
    """Whole if of at most n bytes, else its first n characters and three dots."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def truncate_chars(text: Column, n: int) -> Column:
    """Whole if of at most n characters, else its first n and three dots."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def tags(value: Column) -> Column:
    """The parts between commas, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(value, ","), lambda t: F.trim(t)), lambda t: t != "")


def directory(path: Column, root: str, hidden: tuple[str, ...] = ("notas", "muestra")) -> Column:
    """The name of the folder that holds a file (the root's own for files at the top); null for those in `hidden`."""
    parts = F.split(path, "/")
    name = F.when(F.size(parts) > 1, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.lit(root))
    return F.when((name != "") & ~name.isin(*hidden), name)


def token_estimate(prompt: Column, response: Column) -> Column:
    """A quarter of the bytes of each, rounded down."""
    return F.floor(F.octet_length(prompt) / 4) + F.floor(F.octet_length(response) / 4)
