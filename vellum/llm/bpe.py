"""Byte-level BPE encoding and decoding by ranked merges.

Words (the matches of the tokenizer's pattern) are counted over the corpus.  Spark
higher-order functions fold the merges of a word over its bytes, in hexadecimal: each
step takes the least rank of all neighbouring pairs from a literal map and merges the
pairs that have it, until none has one.  Frequent words are folded once, as rows of
their own, and sent to all tasks up to a bound; a document's other words are folded with
the document, distinct ones once.  No text is shuffled, only counts of words.

Decoding looks up each id's bytes in a literal array and concatenates them.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import once
from vellum.llm.common import bounded_batches, drop_tables, materialise

#: Most words that are sent to all tasks, and their greatest length in characters.
WORDS, LENGTH = 1 << 20, 32
#: Lists that the literal map of ranks is dealt into by a hash.
LISTS = 1 << 16
#: Tokens up to which a word merges one pair at a time.
SHORT = 48


def ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


@cache
def characters(sign: str, top: int) -> str:
    """What a class of characters such as ``\\p{L}`` holds below ``top``, as ranges, asked of
    the tokenizer library, whose Unicode version need not be Python's."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, top))))
    single = {bytes([b]): b for b in range(256)}
    own = tiktoken.Encoding("class", pat_str=sign, mergeable_ranks=single, special_tokens={})
    code = np.unique([ord(c) for c in own.decode(own.encode_ordinary(every))])
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in np.split(code, np.nonzero(np.diff(code) > 1)[0] + 1))


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The words of a text, by the pattern with its classes written out.

    Texts of 16-bit characters, nearly all, take a pattern without the others' ranges,
    which is several times faster."""

    def written_out(top: int) -> re.Pattern:
        out = pattern
        for sign in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
            held = characters(sign.lower() if sign == r"\S" else sign, top)
            out = re.sub(rf"(\[\^?[^\[\]]*){re.escape(sign)}", lambda m, held=held: m[1] + held, out)
            out = out.replace(sign, f"[^{held}]" if sign == r"\S" else f"[{held}]")
        return re.compile(out)

    narrow, wide = written_out(0x10000), written_out(0x110000)
    return lambda text: (narrow if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else wide).findall(text)


def rank_map(known: dict[bytes, int]) -> Column:
    """The ranks as a literal: lists by a hash of the token in hexadecimal, each a map."""
    lists: list[dict[str, int]] = [{} for _ in range(LISTS)]
    for token, rank in known.items():
        name = token.hex().upper()
        lists[xxhash.xxh64_intdigest(name, seed=42) % LISTS][name] = rank
    return F.from_json(F.lit(json.dumps(lists, separators=(",", ":"))), "array<map<string,int>>")


def rank(table: Column, token: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.xxhash64(token), F.lit(LISTS)).cast("int")), token)


def _pair(table: Column, tokens: Column, i: Column) -> Column:
    """Rank of a token and the next; null for the last one."""
    return rank(table, F.concat(F.get(tokens, i), F.get(tokens, i + 1)))


def _state(table: Column, tokens: Column) -> Column:
    """Tokens, and of each the rank of it and the next."""
    return once(tokens, lambda t: F.struct(t.alias("t"), F.transform(t, lambda _, i: _pair(table, t, i)).alias("r")))


def _merged(table: Column, tokens: Column, chosen: Column) -> Column:
    """The state after the merge of the pairs that have a 1 in ``chosen``, a digit a token."""

    def apart(digit: Column) -> Column:
        one = lambda x, i: F.when(F.get(digit, i) == "1", F.lit(None)).when(F.get(digit, i + 1) == "1", F.concat(x, F.get(tokens, i + 1))).otherwise(x)
        return F.filter(F.transform(tokens, one), lambda x: x.isNotNull())

    return _state(table, once(F.split(F.concat(F.lit("0"), chosen), ""), apart))


def _first(table: Column, s: Column, p: Column) -> Column:
    """The state after the merge of the pair at ``p``."""
    t, r = s["t"], s["r"]
    three = lambda i: rank(table, F.concat(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))
    grown = F.transform(t, lambda x, i: F.when(i == p, F.concat(x, F.get(t, p + 1))).otherwise(x))
    ranks = F.transform(F.filter(r, lambda _, i: i != p + 1), lambda x, i: F.when(i == p, three(p)).when(i == p - 1, three(p - 1)).otherwise(x))
    return F.struct(F.filter(grown, lambda _, i: i != p + 1).alias("t"), ranks.alias("r"))


def _alike(table: Column, s: Column, p: Column) -> Column:
    """The state after the merge of all pairs of the least rank, whose first is at ``p``,
    from left to right.

    That is what merging one after the other gives unless a merge makes a pair of lower
    rank, which would have its turn before the rest; then only the first is merged.
    """
    t, r = s["t"], s["r"]
    least = F.get(r, p)

    def lower_between(chosen: Column) -> Column:
        # a merged pair beside the first half of the next one
        three = lambda i: rank(table, F.concat(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))
        lower = lambda digit: F.exists(F.sequence(F.lit(0), F.size(t) - 3), lambda i: (F.get(digit, i) == "1") & F.coalesce(three(i) < least, F.lit(False)))
        return F.contains(chosen, F.lit("101")) & once(F.split(chosen, ""), lower)

    def merge(chosen: Column) -> Column:
        whole = lambda after: F.when((F.coalesce(F.array_min(after["r"]), least) < least) | lower_between(chosen), _first(table, s, p)).otherwise(after)
        return once(_merged(table, t, chosen), whole)

    hits = F.array_join(F.transform(r, lambda x: F.when(x.eqNullSafe(least), "1").otherwise("0")), "")
    return once(F.regexp_replace(hits, "11", "10"), merge)


def _step(table: Column, s: Column) -> Column:
    """Short words merge one pair a step, long ones all pairs of a rank, with equal results."""
    then = lambda p: F.when(p.isNull(), s).when(F.size(s["t"]) <= SHORT, _first(table, s, p)).otherwise(_alike(table, s, p))
    return once(F.array_position(s["r"], F.array_min(s["r"])).cast("int") - 1, then)


def fold(table: Column, word: Column) -> Column:
    """The ids of a word that is not empty; a word that is a token itself is its own."""

    def ids(name: Column) -> Column:
        single = F.regexp_extract_all(name, F.lit(".."), F.lit(0))
        merges = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
        done = F.aggregate(merges, _state(table, single), lambda s, _: _step(table, s), lambda s: F.transform(s["t"], lambda t: rank(table, t)))
        return once(rank(table, name), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(done))

    return once(F.hex(word.cast("binary")), ids)


def spark_pattern(pattern: str) -> str:
    """For the engine's own regular expressions: white space as Unicode has it."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def frequent(docs: DataFrame, table: Column, pattern: str, most: int = WORDS) -> pa.Table:
    """``word, ids`` of the words that occur most, at least twice, counted over all texts.

    Words of equal counts, by eighths of a power of two, are all in or all out, so that
    there are at most ``most``."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(spark_pattern(pattern)), F.lit(0))).alias("word")).where(F.length("word") <= LENGTH)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts.select("word", F.floor(8 * F.log2("n")).cast("int").alias("step")), "words")
    total, least = 0, 1 << 30
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    spread = counts.where(F.col("step") >= least).select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    found = spread.select("word", fold_all(table, F.array("word"))[0].alias("ids")).toArrow()
    drop_tables(counts)
    return found


def fold_all(table: Column, words: Column) -> Column:
    """The ids of each of a list of words; the table is looked at once a row."""
    return once(table, lambda held: F.transform(words, lambda w: fold(held, w)))


class Known(dict):
    """Ids of words, in bytes; a word that is not known gets the place, from -1 down, that
    it has or takes in ``rare``."""

    rare: dict[str, int]

    @classmethod
    def of(cls, table: pa.Table) -> Known:
        known = cls()
        for batch in table.to_batches(10_000):
            values, ends = batch["ids"].flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(), np.cumsum([0, *pc.list_value_length(batch["ids"]).to_pylist()]) * 4
            known.update((w, values[a:b]) for w, a, b in zip(batch["word"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return known

    def __missing__(self, word: str) -> bytes:
        return (-1 - self.rare.setdefault(word, len(self.rare))).to_bytes(4, "little", signed=True)


class Dictionary:
    """A table of words as it is sent; each worker makes its dictionary of it once."""

    def __init__(self, table: pa.Table):
        self.table = table

    def known(self) -> Known:
        if not hasattr(self, "made"):
            self.made = Known.of(self.table)
        return self.made


def _looked_up(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = shared.value.known(), splitter(pattern)
        for batch in batches:
            ids, rares = [], []
            for text in batch["text"]:
                known.rare = {}
                ids.append(b"".join(map(known.__getitem__, split(text.as_py()))))
                rares.append(list(known.rare))
            runs, gaps = _parted(np.frombuffer(b"".join(ids), "<i4"), np.cumsum([0, *(len(i) // 4 for i in ids)]))
            yield pa.record_batch({"doc_id": batch["doc_id"], "runs": runs, "gaps": gaps, "rare": pa.array(rares, pa.list_(pa.string()))})

    return run


def _parted(ids: np.ndarray, ends: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Of the ids of documents that end at ``ends``: of each document the runs of ids
    before, between and after its rare words, and these words' numbers."""
    at = np.nonzero(ids < 0)[0]
    first = np.searchsorted(at, ends)  # the rare words before each document's end
    sizes = np.sort(np.concatenate((ends[1:], at))) - np.sort(np.concatenate((ends[:-1], at + 1)))
    lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
    runs = lists(np.concatenate(([0], np.cumsum(sizes))), pa.array(ids[ids >= 0]))
    return lists(first + np.arange(len(ends)), runs), lists(first, pa.array(-1 - ids[at]))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, most: int = WORDS) -> DataFrame:
    """``doc_id, ids`` of ``docs(doc_id, text)`` by the rank file at ``path``.

    Null texts are empty; these have no ids.  Rows that repeat are encoded each, null ids
    stay, an empty table gives none; other columns are not read.  A word of n bytes costs
    up to n steps over its tokens, fewer where pairs repeat.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = rank_map(ranks(path))
    known = spark.sparkContext.broadcast(Dictionary(frequent(rows, table, pattern, most)))
    found = rows.mapInArrow(_looked_up(known, pattern), "doc_id long, runs array<array<int>>, gaps array<int>, rare array<string>")
    filled = lambda own: F.flatten(F.transform("runs", lambda run, i: F.when(i < F.size("gaps"), F.concat(run, F.get(own, F.get("gaps", i)))).otherwise(run)))
    return found.select("doc_id", once(fold_all(table, F.col("rare")), filled).alias("ids"))


def decode(ids: Column, path: str) -> Column:
    """The bytes of a list of ids; an id that the file does not have gives null."""
    known = {r: t for t, r in ranks(path).items()}
    names = F.split(F.lit(",".join(known[i].hex() if i in known else "?" for i in range(max(known) + 1))), ",")
    return once(names, lambda held: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(held, i)), "", "?")))


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to."""
    rows = encode(docs, path, pattern)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
