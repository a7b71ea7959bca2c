"""Text columns: accent folding, tokens, sentences, slugs, list joins."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs() -> tuple[str, str]:
    """Letters whose compatibility decomposition begins with an ASCII letter or digit, and that letter, by rule."""
    have, give = [], []
    for point in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(parts) == 1 and parts.isalnum() and chr(point) == chr(point).lower():
            have.append(chr(point))
            give.append(parts)
    return "".join(have), "".join(give)


ACCENTED, PLAIN = _pairs()


def fold(text: Column) -> Column:
    """Lower case, without accents; other non-ASCII characters are dropped. Texts that are ASCII already take the short way."""
    full = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(full)


def squeeze(text: Column) -> Column:
    """fold with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))


def tokens(text: Column, stop: list[str] | tuple[str, ...] = ()) -> Column:
    """Runs of letters and digits of the folded text, of two characters or more, without stop words."""
    if all(re.fullmatch("[a-z0-9]+", w) for w in stop):  # one search that passes over stop words, no list of all runs
        skipped = rf"(?!(?:{'|'.join(stop)})(?![a-z0-9]))" if stop else ""
        return F.regexp_extract_all(fold(text), F.lit(rf"(?<![a-z0-9]){skipped}[a-z0-9]{{2,}}"), F.lit(0))
    runs = F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(runs, lambda t: (F.length(t) > 1) & ~F.array_contains(F.array(*map(F.lit, stop)), t))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(
        F.array().cast("array<string>")
    )


def sentences(text: Column) -> Column:
    """Cut after a full stop that white space follows."""
    return F.split(text, r"(?<=\.)\s+")


def listed(items: Column, last: str = " e ") -> Column:
    """'a, b e c'; empty items are left out."""
    some = F.filter(items, lambda x: x != "")
    return F.when(F.size(some) == 0, "").when(F.size(some) == 1, some[0]).otherwise(
        F.concat(F.array_join(F.slice(some, 1, F.greatest(F.lit(1), F.size(some) - 1)), ", "), F.lit(last), F.element_at(some, -1))
    )


def items(text: Column, pattern: str = r",| and | e ") -> Column:
    """The parts of a written list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def bounded(text: Column, surface: Column) -> Column:
    """Whether the surface occurs with no word character or hyphen at either side; a plain search comes first."""
    return F.contains(text, surface) & F.regexp_like(text, F.concat(F.lit(r"(?<![\w-])\Q"), surface, F.lit(r"\E(?![\w-])")))


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit("::"), F.lower(F.trim(name)))


def node_name(node: Column) -> Column:
    return F.element_at(F.split(node, "::"), -1)


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, node_name), " -> ")
