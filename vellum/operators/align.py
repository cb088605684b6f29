"""Character alignment of text columns (ALN1-20).

The alignment itself is an Arrow kernel on bounded texts; long documents are aligned
segment by segment, as rows of their own, or from state carried along one book.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import affine, banded, matching, waves
from vellum.functions import text as tx

SPAN = "struct<a_start:int,a_end:int,b_start:int,b_end:int>"
ALIGNED = f"struct<score:double,spans:array<{SPAN}>>"


def aligner(mode: str = "local", **scores):
    """ALN1-4: a Column function ``(a, b) -> struct(score, spans)``.

    ``global`` takes whole texts of any length, in memory that grows with their length;
    ``local`` is for segments.  The texts of a batch are aligned together where the scores
    allow (:func:`vellum.functions.waves.sound`)."""
    one = banded.align_whole if mode == "global" else partial(affine.align, mode=mode)

    def many(pairs: list[tuple[str, str]]) -> list[tuple[float, affine.Spans]]:
        if not waves.sound(mode, **scores):
            return [one(p, q, **scores) for p, q in pairs]
        return waves.align_all(pairs, mode, **{k: v for k, v in scores.items() if k != "mismatch"})

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")])))]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = list(zip(a, b, strict=True))
        done = iter(many([p for p in pairs if None not in p]))
        found = [(None, None) if None in p else next(done) for p in pairs]
        names = ("a_start", "a_end", "b_start", "b_end")
        return pd.DataFrame({"score": [f[0] for f in found], "spans": [None if f[1] is None else [dict(zip(names, s, strict=True)) for s in f[1]] for f in found]})

    return run.asNondeterministic()  # so that it runs once a row, whatever uses its result


def match_string(a: Column, b: Column, gap: str = " ") -> Column:
    """ALN5: ``|`` equal, ``-`` a gap on either side, ``.`` otherwise."""
    sign = lambda x, y: F.when(x == y, "|").when((x == gap) | (y == gap), "-").otherwise(".")
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), sign), "")


def edit_strings(a: Column, b: Column, spans: Column, orientation: str = "original") -> Column:
    """ALN6-8: ``struct(a, b, ops)``, three texts of equal length, out of aligned spans.

    Each span's unaligned text before it comes first, a's and then b's; spans are cut out
    of the raw texts and compacted.  With orientation ``original`` what only a has is a
    deletion ``-``; with ``reference`` it is an insertion ``+``.  Spans of unequal compact
    length give null.
    """
    only_a, only_b = ("-", "+") if orientation == "original" else ("+", "-")
    cut = lambda t, i, j: tx.compact(F.array_join(F.slice(t, i + 1, F.greatest(j - i, F.lit(0))), ""))

    def blocks(x: Column, y: Column, same: Column) -> Column:
        """What only a has, what only b has, and what is aligned."""
        n, m = F.length(x), F.length(y)
        blank = lambda k: F.repeat(F.lit(" "), k)
        ops = F.concat(F.repeat(F.lit(only_a), n), F.repeat(F.lit(only_b), m), same["ops"])
        return F.struct(F.concat(x, blank(m), same["a"]).alias("a"), F.concat(blank(n), y, same["b"]).alias("b"), ops.alias("ops"), same["ok"].alias("ok"))

    def whole(given: Column) -> Column:
        spans, a, b = given["spans"], given["a"], given["b"]

        def piece(s: Column, k: Column) -> Column:
            before = lambda side: F.when(k > 0, F.get(spans, k - 1)[f"{side}_end"]).otherwise(0)
            parts = F.struct(
                cut(a, before("a"), s["a_start"]).alias("x"), cut(b, before("b"), s["b_start"]).alias("y"), cut(a, s["a_start"], s["a_end"]).alias("p"), cut(b, s["b_start"], s["b_end"]).alias("q"),
            )

            def joined(c: Column) -> Column:
                fit = F.length(c["p"]) == F.length(c["q"])
                same = F.struct(c["p"].alias("a"), c["q"].alias("b"), F.when((F.length(c["p"]) > 0) & fit, match_string(c["p"], c["q"], "\0")).otherwise("").alias("ops"), fit.alias("ok"))
                return tx.once(same, lambda d: blocks(c["x"], c["y"], d))

            return tx.once(parts, joined)

        end = lambda side: F.coalesce(F.try_element_at(spans, F.lit(-1))[f"{side}_end"], F.lit(0))
        nothing = F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("ops"), F.lit(True).alias("ok"))
        tail = blocks(cut(a, end("a"), F.size(a)), cut(b, end("b"), F.size(b)), nothing)
        every = F.concat(F.transform(spans, piece), F.array(tail))
        joined_up = lambda ps: F.when(F.forall(ps, lambda p: p["ok"]), F.struct(*[F.array_join(ps[c], "").alias(c) for c in ("a", "b", "ops")]))
        return tx.once(every, joined_up)

    # characters, so that a cut does not walk through all of the text before it
    return tx.once(F.struct(spans.alias("spans"), tx.characters(a).alias("a"), tx.characters(b).alias("b")), whole)


def edit_documents(aligned: DataFrame, orientation: str = "original", on_error: str = "skip") -> DataFrame:
    """ALN8: ``aligned(doc_id, a, b, spans)`` to ``doc_id, a, b, ops``; a document whose
    spans do not fit is left out, or kept with null texts by ``on_error="null"``."""
    made = aligned.withColumn("_s", edit_strings(F.col("a"), F.col("b"), F.col("spans"), orientation))
    kept = made.where("_s IS NOT NULL") if on_error == "skip" else made
    return kept.select("doc_id", "_s.*")


def suspicious(spans: Column, a: Column, b: Column) -> Column:
    """FLT14: a long unaligned tail, or too little of a text aligned: ``failed``, ``bad``
    or ``ok``; the older rule is ``strict``."""
    aligned = F.aggregate(spans, F.lit(0), lambda s, x: s + x["a_end"] - x["a_start"])
    last = F.element_at(spans, -1)
    tail = F.greatest(F.length(a) - last["a_end"], F.length(b) - last["b_end"])
    share = aligned.cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))
    late = F.aggregate(spans, F.lit(0), lambda s, x: s + F.greatest(F.lit(0), x["a_end"] - F.greatest(x["a_start"], F.length(a) - 200)))
    rule = F.when((F.size(spans) == 0) | (share < 0.5), "failed").when((tail > 200) & (late < 50), "bad").otherwise("ok")
    return F.struct(rule.alias("rule"), ((F.size(spans) == 0) | (tail > 200) | (share < 0.9)).alias("strict"))


def extent(spans: Column, side: str = "b") -> Column:
    """First aligned start and last aligned end on a side; null without spans."""
    return F.when(F.size(spans) > 0, F.struct(spans[0][f"{side}_start"].alias("start"), F.try_element_at(spans, F.lit(-1))[f"{side}_end"].alias("end")))


def prune(prediction: Column, spans: Column) -> Column:
    """ALN14: the prediction from its first to its last aligned character."""
    e = extent(spans)
    return F.substring(prediction, e["start"] + 1, e["end"] - e["start"])


def prune_predictions(pairs: DataFrame, source: str = "input", prediction: str = "output", gap_open: float = -1.0, gap_extend: float = -0.5) -> DataFrame:
    """ALN14, FLT14 over whole texts: ``doc_id, pruned, rule``.

    Both texts are composed and lower-cased, aligned globally with free ends, and the raw
    prediction is cut to what its first to its last aligned character come from.  Where
    nothing aligns the prediction is null and the rule ``failed``; null texts give nulls.
    """
    mapped = tx.normalize_lower_mapped(F.col(prediction))
    ready = pairs.select("doc_id", F.col(prediction).alias("raw"), tx.normalize_lower(F.col(source)).alias("a"), mapped.alias("m"))
    aligned = ready.select("*", aligner("global", gap_open=gap_open, gap_extend=gap_extend, free_ends=True)(F.col("a"), F.col("m.text"))["spans"].alias("spans"))
    return aligned.select("doc_id", prune_raw(F.col("raw"), F.col("m"), F.col("spans")).alias("pruned"), F.when(F.col("spans").isNotNull(), suspicious(F.col("spans"), F.col("a"), F.col("m.text"))["rule"]).alias("rule"))


def prune_raw(prediction: Column, mapped: Column, spans: Column) -> Column:
    """ALN14 where the spans are of the prediction's lower-case composition
    (``text.normalize_lower_mapped``): the raw prediction over the same extent."""
    e, origin = extent(spans), mapped["origin"]
    start = F.get(origin, e["start"])
    end = F.coalesce(F.get(origin, e["end"]), F.length(prediction))
    return F.substring(prediction, start + 1, end - start)


def project_extent(fmt: Column, spans: Column, side: str = "b") -> Column:
    """ALN15, ALN20: the aligned extent of a compact text as positions in the raw text,
    by the map of ``text.suppress_format``."""
    e, words = extent(spans, side), fmt["map"]["words"]
    return F.struct(F.get(words, e["start"]).alias("start"), (F.get(words, e["end"] - 1) + 1).alias("end"))


def segment_offsets(segments: DataFrame) -> DataFrame:
    """WIN2: for ``doc_id, seg, a, b``, the compact characters before each segment."""
    before = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(F.length(tx.compact(F.col(c)))).over(before), F.lit(0)).cast("int")
    return segments.select("doc_id", "seg", "a", "b", ahead("a").alias("a_before"), ahead("b").alias("b_before"))


def align_segments(segments: DataFrame, **scores) -> DataFrame:
    """ALN9: paired segments, aligned as rows of their own and shifted by what precedes.

    ``doc_id, seg, span``; empty segments give no rows.
    """
    placed = segment_offsets(segments)
    found = aligner("local", **scores)(tx.compact(F.col("a")), tx.compact(F.col("b")))
    rows = placed.select("doc_id", "seg", "a_before", "b_before", F.explode(found["spans"]).alias("s"))
    shift = [(F.col(f"s.{s}_{e}") + F.col(f"{s}_before")).alias(f"{s}_{e}") for s in "ab" for e in ("start", "end")]
    return rows.select("doc_id", "seg", F.struct(*shift).alias("span"))


#: Compact characters that a segment's counterpart may be longer, and raw
#: characters that are looked at beyond a segment's length.
SLACK, AHEAD = 250, 3000


def align_sequential(books: DataFrame, slack: int = SLACK, ahead: int = AHEAD, **scores) -> DataFrame:
    """ALN10: segments of one text against the other whole, consumed from left to right.

    ``books(doc_id, segments, text)`` to ``doc_id, spans, flagged``.  What a segment may
    align to is bounded by its length and ``slack``, so memory is bounded; books run in
    parallel.  Offsets are in compact texts.
    """

    def one(segments: list[str], text: str) -> tuple[list[dict], bool]:
        spans, flagged, ref, consumed = [], False, 0, 0
        for segment in segments:
            short = segment.translate(DROP)
            room = text[: len(segment) + ahead]
            keep = [i for i, c in enumerate(room) if c not in "\n -"]
            if short and keep:
                room = room[: keep[min(len(short) + slack, len(keep) - 1)]]
                keep = [i for i in keep if i < len(room)]
                _, found = affine.align(short, room.translate(DROP), "local", **scores)
                flagged = flagged or not found
                if found:
                    spans += [{"a_start": a + ref, "a_end": b + ref, "b_start": c + consumed, "b_end": d + consumed} for a, b, c, d in found]
                    end = found[-1][3]
                    ref, consumed, text = ref + len(short), consumed + end, text[keep[end - 1] + 1 :]
        return spans, flagged

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(list(s), t) for s, t in zip(batch["segments"], batch["text"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": [d[0] for d in done], "flagged": [d[1] for d in done]})

    return books.select("doc_id", F.coalesce("segments", F.array().cast("array<string>")).alias("segments"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {books.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>, flagged boolean")


DROP = {ord(c): None for c in "\n -"}


def diff_lines(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """ALN11, SNK7: ``doc_id, line, ops``: line by line, the opcodes that turn one text into
    the other, the shorter text padded with empty lines.  Equal lines need no search."""

    @F.pandas_udf(OPS)
    def search(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [dict(zip(("tag", "i1", "i2", "j1", "j2"), o, strict=True)) for o in matching.opcodes(p, q)] for p, q in zip(x, y, strict=True)], dtype=object)

    lines = lambda c: F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r?\n$", ""), r"\r?\n")
    zipped = pairs.select("doc_id", F.posexplode(F.arrays_zip(lines(a).alias("x"), lines(b).alias("y"))).alias("line", "p"))
    both = zipped.select("doc_id", "line", F.coalesce("p.x", F.lit("")).alias("x"), F.coalesce("p.y", F.lit("")).alias("y"))
    differ = lambda c: F.when(F.col("x") != F.col("y"), F.col(c))
    n = F.length("x")
    same = F.array(F.struct(F.lit("equal").alias("tag"), F.lit(0).alias("i1"), n.alias("i2"), F.lit(0).alias("j1"), n.alias("j2")))
    equal = F.when(n > 0, same).otherwise(F.array().cast(OPS))
    searched = both.select("doc_id", "line", "x", "y", search(differ("x"), differ("y")).alias("found"))
    return searched.select("doc_id", "line", F.when(F.col("x") == F.col("y"), equal).otherwise(F.col("found")).alias("ops"))


OPS = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def _cells(a: Column, b: Column, spans: Column, cell) -> Column:
    """For each span, ``cell(i, j, equal)`` of its pairs of characters."""
    both = F.struct(tx.characters(a).alias("a"), tx.characters(b).alias("b"))

    def one(signs: Column):
        def pairs(s: Column) -> Column:
            n = s["a_end"] - s["a_start"]
            at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda k: cell(s["a_start"] + k, s["b_start"] + k, F.get(signs["a"], s["a_start"] + k) == F.get(signs["b"], s["b_start"] + k)))

        return F.transform(spans, pairs)

    return tx.once(both, one)


def match_mask(b: Column, spans: Column, a: Column) -> Column:
    """ALN12, SNK7: for each character of b, whether it is aligned to an equal one; spans
    are in order, as the kernel gives them."""
    hits = _cells(a, b, spans, lambda i, j, equal: equal)
    none = lambda n: F.array_repeat(F.lit(False), F.greatest(n, F.lit(0)))

    def joined(found: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(spans, k - 1)["b_end"]).otherwise(0)
        parts = F.transform(spans, lambda s, k: F.concat(none(s["b_start"] - before(k)), F.get(found, k)))
        tail = none(F.length(b) - F.coalesce(F.element_at(F.transform(spans, lambda s: s["b_end"]), -1), F.lit(0)))
        return F.concat(F.flatten(parts), tail)

    return F.when(F.size(spans) > 0, tx.once(hits, joined)).otherwise(none(F.length(b)))


def alignment_cells(rows: DataFrame) -> DataFrame:
    """ALN13: the sparse matrix of ``doc_id, a, b, spans``: 1 equal, 0.5 aligned."""
    value = lambda i, j, equal: F.struct(i.alias("i"), j.alias("j"), F.when(equal, 1.0).otherwise(0.5).alias("v"))
    return rows.select("doc_id", F.inline(F.flatten(_cells(F.col("a"), F.col("b"), F.col("spans"), value))))


def merge_overlap(a: str, b: str, **scores) -> str:
    """ALN16: a up to the end of what aligns to b, then b from the end of that."""
    ends = []
    for x, y in ((a, b), (b, a)):
        keep = [i for i, c in enumerate(x) if c not in "\n -"]
        _, spans = affine.align(x.translate(DROP), y.translate(DROP), "local", **scores)
        if not spans:
            raise ValueError("nothing aligns")
        ends.append(keep[spans[-1][1] - 1] + 1)
    return a[: ends[0]] + b[ends[1] :]


def _folding(parts: list[str]) -> Generator[tuple[str, str], tuple[int, int] | None, str]:
    """ALN17; yields the compact texts whose local alignment's ends it needs next."""
    out = parts[0] if parts else ""
    for part in parts[1:]:
        at = max(0, len(out) - len(part))
        tail = out[at:] if part else ""
        ends = yield tail.translate(DROP), part.translate(DROP)
        if ends is None:
            out += part
            continue
        keep = [[i for i, c in enumerate(t) if c not in "\n -"][e - 1] + 1 for t, e in zip((tail, part), ends, strict=True)]
        out = out[: at + keep[0]] + part[keep[1] :]
    return out


def _foreseen(parts: list[str]) -> Iterator[tuple[str, str]]:
    """What :func:`_folding` asks where parts overlap by equal text."""
    out, most = parts[0] if parts else "", max(map(len, parts), default=0)
    for part in parts[1:]:
        tail = out[max(0, len(out) - len(part)) :] if part else ""
        yield tail.translate(DROP), part.translate(DROP)
        at = tail.find(part[:16])
        while at >= 0 and not part.startswith(tail[at:]):
            at = tail.find(part[:16], at + 1)
        out = (out + part[len(tail) - at if at >= 0 else 0 :])[-most:]


def fold_all(lists: list[list[str]], **scores) -> list[str]:
    """ALN17: each list of overlapping texts as one; a part that does not align is appended.
    Of all lists, all parts are aligned together as far as they can be foreseen, then those that are next."""
    found: list = [None] * len(lists)

    def ends(x: str, y: str) -> tuple[int, int] | None:
        a, b = (affine.align(*p, "local", **scores)[1] for p in ((x, y), (y, x)))
        return (a[-1][1], b[-1][1]) if a and b else None

    def all_ends(pairs: list[tuple[str, str]]) -> list[tuple[int, int] | None]:
        return waves.local_ends(pairs, **{k: v for k, v in scores.items() if k != "mismatch"}) if waves.sound("local", **scores) else [ends(*p) for p in pairs]

    ahead = list(dict.fromkeys(pair for parts in lists for pair in _foreseen(parts)))
    known = dict(zip(ahead, all_ends(ahead), strict=True))
    going, told = {i: _folding(parts) for i, parts in enumerate(lists)}, dict.fromkeys(range(len(lists)))
    while told:
        asked = {}
        for i, answer in told.items():
            try:
                while (pair := going[i].send(answer)) in known:
                    answer = known[pair]
                asked[i] = pair
            except StopIteration as end:
                found[i] = end.value
                del going[i]
        told = dict(zip(asked, all_ends(list(asked.values())), strict=True))
    return found


def fold_overlaps(parts: list[str], **scores) -> str:
    """:func:`fold_all` for one list."""
    return fold_all([parts], **scores)[0]


#: Characters of parts that are folded at once.
FOLDED = 1 << 22


def stretches(lists: pd.Series) -> Iterator[slice]:
    """Rows whose parts together have some ``FOLDED`` characters."""
    first = size = 0
    for i, parts in enumerate(lists):
        size += sum(len(x or "") for x in parts) if parts is not None else 0
        if size > FOLDED or i + 1 == len(lists):
            yield slice(first, i + 1)
            first, size = i + 1, 0


def merge_documents(docs: DataFrame, **scores) -> DataFrame:
    """ALN16, ALN17 over ``doc_id, parts``; null parts give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in stretches(batch["parts"]):
                parts = batch["parts"].iloc[at]
                done = iter(fold_all([[x or "" for x in p] for p in parts if p is not None], **scores))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at], "text": [None if p is None else next(done) for p in parts]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "parts").mapInPandas(run, f"doc_id {kind}, text string")


def _dense_run(ops: str, width: int, least: float, take: str) -> tuple[int, int]:
    hit = np.frombuffer(ops.encode("utf-32-le", "surrogatepass"), np.uint32) == ord("|")
    n, before = len(hit), np.concatenate(([0], np.cumsum(hit)))
    at = np.arange(n)
    left = np.where(at >= width, before[at] - before[np.maximum(at - width, 0)], 0) / width
    right = (before[np.minimum(at + width, n)] - before[at]) / width
    good = (np.maximum if take == "max" else np.minimum)(left, right) >= least
    turns = np.nonzero(np.diff(np.concatenate(([0], good, [0])).astype(np.int8)))[0].reshape(-1, 2)
    if not len(turns):
        return -1, -1
    start, end = turns[int((turns[:, 1] - turns[:, 0]).argmax())].tolist()
    return start, end - 1


def dense_runs(edits: DataFrame, width: int = 10, least: float = 0.8, take: str = "max") -> DataFrame:
    """ALN18, ALN19, WIN4: the first longest run of positions where enough of the
    ``width`` operations before or from it are matches: ``doc_id, start, end`` inclusive,
    -1 without any; ``take`` is ``max``, or ``min`` to ask for both sides.

    Each text is smoothed within its row by running sums.  A side that would reach beyond
    the beginning counts as 0.
    """

    @F.pandas_udf("struct<start:int,end:int>")
    def longest(ops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_dense_run(o or "", width, least, take) for o in ops], columns=["start", "end"])

    return edits.select("doc_id", longest("ops").alias("r")).select("doc_id", "r.start", "r.end")
