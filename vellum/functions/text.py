"""Text functions as Column expressions (TXT1-26).

White space is what Python calls white space.  Case folding and compatibility
composition have no built-in, so one Arrow function does both; everything else is an
expression that Catalyst sees through.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"


def _composer(fold: bool, lower: bool = False):
    @F.pandas_udf(T.StringType())
    def compose(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None or t.isascii() and not fold and not lower:
                return t
            if lower:
                return unicodedata.normalize("NFKC", t).lower()
            return unicodedata.normalize("NFKC", t.casefold() if fold else t)

        return text.map(one, na_action="ignore")

    return compose


def compose(text: Column, casefold: bool = False) -> Column:
    """Optional case folding, then compatibility composition."""
    return _composer(casefold)(text)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def normalize(text: Column, lowercase: bool = False, modernize: bool = False) -> Column:
    """TXT1: optional w to v, runs of white space to one space (ends are kept), then
    optional case folding and composition."""
    return compose(squeeze(F.translate(text, "wW", "vV") if modernize else text), lowercase)


def normalize_words(text: Column, lowercase: bool = False, quotes: bool = False) -> Column:
    """TXT2; TXT3 with ``lowercase`` and ``quotes``: joins words hyphenated at line ends,
    drops hyphens and sentence signs."""
    return compose(squeeze(_joined(text, quotes)), lowercase)


def _joined(text: Column, quotes: bool) -> Column:
    return F.translate(F.regexp_replace(text, r"-(?U)[\s\x{1c}-\x{1f}]+", ""), '-.,?!:;"' if quotes else "-.,?!:;", "")


def written_words(text: Column, quotes: bool = False) -> Column:
    """The words of :func:`normalize_words` before folding and composition.  White space
    neither composes nor changes places with what follows, so :func:`composed_words` of
    each gives the words of the whole text."""
    return tokenize(_joined(text, quotes))


def composed_words(word: Column, lowercase: bool = False) -> Column:
    """What becomes of a written word: one word, or several where a sign of it stands for
    white space and others."""
    return tokenize(compose(word, lowercase))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def normalize_display(text: Column, lowercase: bool = False) -> Column:
    """TXT4; TXT5 with ``lowercase``: also strips both ends."""
    return compose(F.regexp_replace(squeeze(text), "^ | $", ""), lowercase)


def normalize_lower(text: Column) -> Column:
    """TXT6: composition, then lower case.  May change lengths, so offsets into the
    result are not offsets into the text; see ``align.prune``."""
    return _composer(False, lower=True)(text)


def _pieces(text: str) -> list[str]:
    """A text cut where its parts compose alone as they do together."""
    out: list[str] = []
    compose = lambda t: unicodedata.normalize("NFKC", t)
    for c in text:
        if out and not (c.isascii() and out[-1].isascii()) and compose(out[-1] + c) != compose(out[-1]) + compose(c):
            out[-1] += c
        else:
            out.append(c)
    return out


def _lowered(text: str) -> tuple[str, np.ndarray]:
    """A text composed and in lower case, and where each character's piece begins.  Characters
    of ASCII that no other follows are pieces of their own and stay as long as they are."""
    done, origin, at = [], [], 0
    for odd in [*re.finditer(r"[\x00-\x7f]?[^\x00-\x7f]+", text), None]:
        end = odd.start() if odd else len(text)
        done.append(text[at:end].lower())
        origin.append(np.arange(at, end, dtype=np.int32))
        at = end
        for piece in _pieces(odd[0]) if odd else []:
            done.append(unicodedata.normalize("NFKC", piece).lower())
            origin.append(np.full(len(done[-1]), at, np.int32))
            at += len(piece)
    return "".join(done), np.concatenate(origin)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("origin", T.ArrayType(T.IntegerType()))]))
def _lower_mapped(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else _lowered(t) for t in text], columns=["text", "origin"])


def normalize_lower_mapped(text: Column) -> Column:
    """TXT6 with ``origin``: for each character of the result, where in the text the piece
    begins that it comes from."""
    return _lower_mapped.asNondeterministic()(text)  # so that it runs once a row


def compact(text: Column) -> Column:
    """TXT7: without line feeds, spaces and hyphens."""
    return F.translate(text, "\n -", "")


def once(value: Column, f) -> Column:
    """``f`` of a value that it uses many times: as the argument of a lambda function the
    value is computed once a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def format_map(text: Column) -> Column:
    """TXT8: positions of spaces, line feeds, hyphens and everything else."""

    def places(signs: Column) -> Column:
        at = F.when(F.size(signs) > 0, F.sequence(F.lit(0), F.size(signs) - 1)).otherwise(F.array().cast("array<int>"))
        pick = lambda s: F.filter(at, lambda i: F.get(signs, i) == s)
        words = F.filter(at, lambda i: ~F.get(signs, i).isin(" ", "\n", "-"))
        return F.struct(pick(" ").alias("spaces"), pick("\n").alias("new_lines"), words.alias("words"), pick("-").alias("dashes"))

    return F.when(text.isNotNull(), once(characters(text), places))


def suppress_format(text: Column) -> Column:
    """TXT9: compact text, its map, and how many characters were removed."""
    return F.struct(compact(text).alias("text"), format_map(text).alias("map"), (F.length(text) - F.length(compact(text))).alias("removed"))


def restore_format(text: Column, fmt: Column) -> Column:
    """TXT10: the inverse of :func:`suppress_format`; null if the text is too short."""
    place = lambda at, s: F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(s).alias("s")))
    letters = once(characters(text), lambda signs: F.transform(fmt["words"], lambda i, k: F.struct(i.alias("i"), F.get(signs, k).alias("s"))))
    parts = F.array_sort(F.concat(place(fmt["spaces"], " "), place(fmt["new_lines"], "\n"), place(fmt["dashes"], "-"), letters))
    return F.when(F.length(text) >= F.size(fmt["words"]), F.array_join(F.transform(parts, lambda p: p["s"]), ""))


def visible_length(text: Column) -> Column:
    """TXT11: characters that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def tokenize(text: Column) -> Column:
    """TXT12: by white space, without empty tokens."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def term_count(text: Column, term: str) -> Column:
    """TXT13: whole words, any case."""
    return F.regexp_count(text, F.lit(rf"(?iU)\b\Q{term}\E\b"))


def url_id(url: Column) -> Column:
    """TXT14: the last path segment without ``.txt``."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".txt"), F.lit(""))


def word_segments(text: Column, n: int = 300, drop_tail: bool = False) -> Column:
    """TXT16; TXT18 with ``drop_tail``: runs of n words joined by a space."""

    def cut(words: Column) -> Column:
        whole = F.floor(F.size(words) / n) * n if drop_tail else F.size(words)
        starts = F.when(whole > 0, F.sequence(F.lit(0), (whole - 1).cast("int"), F.lit(n)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " ")), F.array().cast("array<string>"))

    return once(tokenize(text), cut)  # the text is split once, not once for each segment


def overlap_windows(text: Column, window: int, overlap: float) -> Column:
    """TXT17: windows of ``window`` tokens that share ``overlap`` of them, each up to the
    next token's start; the last runs to the end of the last token."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)[^\s]+[\s]*"), F.lit(0))
    shared = window * overlap
    begin = lambda i: F.floor(i * F.lit(window - shared)).cast("int")
    end = lambda i: F.floor((i + 1) * F.lit(float(window)) - i * F.lit(shared)).cast("int")

    def cut(found: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.size(found) / F.lit(window - shared)).cast("int"))
        rows = F.filter(steps, lambda i: (begin(i) < F.size(found)) & ((i == 0) | (end(i - 1) < F.size(found))))
        last = lambda i: end(i) >= F.size(found)
        part = lambda i: F.array_join(F.slice(found, begin(i) + 1, end(i) - begin(i)), "")
        return F.transform(rows, lambda i: F.when(last(i), F.regexp_replace(part(i), rf"{SPACE}$", "")).otherwise(part(i)))

    # a one-element transform splits the text once, not once for each window
    return F.when(F.size(tokens) > 0, F.get(F.transform(F.array(tokens), cut), F.lit(0))).otherwise(F.array().cast("array<string>"))


def random_window(text: Column, key: Column, window: int, seed: int = 0) -> Column:
    """TXT19: a window of tokens at a place that key and seed decide."""
    words = tokenize(text)
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.size(words) - window + 1, F.lit(1)).cast("long"))
    return F.array_join(F.slice(words, at.cast("int") + 1, window), " ")


def tail_from_space(text: Column, cut_off: int = 100) -> Column:
    """TXT20: the ending that starts with the last space or line feed at least
    ``cut_off`` characters from the end; null if there is none."""
    head = F.substring(text, F.lit(1), F.length(text) - cut_off + 1)
    kept = F.length(F.regexp_extract(head, r"(?s)^(.*)[ \n]", 1))
    return F.when(head.rlike(r"[ \n]"), F.substring(text, kept + 1, F.length(text)))


def chop_pattern(words: int) -> str:
    """What TXT21 keeps, as the first group: behind it stand the two last characters of
    the word reached (one, if the text begins with a word of one), then the words that
    end the text, the last of them perhaps empty."""
    return rf"(?s)^(?:(.*).)?[^ \n](?:[ \n]+[^ \n]+){{{words - 1}}}[ \n]+[^ \n]*$"


def chop_end(text: Column, words: int = 5) -> Column:
    """TXT21: drops the last words; the cut also takes the last two characters of the
    word it reaches.  Null if the text is too short."""
    return F.when(text.rlike(chop_pattern(words)), F.regexp_extract(text, chop_pattern(words), 1))


def prompt(prefix: str, *parts: Column) -> Column:
    """TXT22."""
    return F.concat(F.lit(prefix), *parts)


def after_marker(text: Column, marker: str = "[/INST]") -> Column:
    """TXT23: what follows the last marker, stripped."""
    return strip(F.substring_index(text, marker, -1))


def model_name(model: Column, quantization: Column, names: dict[str, str]) -> Column:
    """TXT24: a served model's name with its quantization; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.concat(table[model], F.lit("-"), quantization)


def unordered(a: Column, b: Column, fa: Column, fb: Column) -> list[Column]:
    """TXT25: a pair in order, its frequencies swapped with it."""
    return [F.least(a, b), F.greatest(a, b), F.when(a <= b, fa).otherwise(fb), F.when(a <= b, fb).otherwise(fa)]


def show_gaps(text: Column) -> Column:
    """TXT26."""
    return F.translate(text, " ", "∅")
