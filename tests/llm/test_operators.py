"""Training-data operators against brute force on small tables with awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import embeddings, exact, langid, licenses, mixing, packing, simhash, substring, toxicity, urls
from vellum.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "clash", "clash") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "to", "ri", "sel"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = [(i, text(rng.randint(1, 80)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(60)]
    out += [(100 + i, out[7][1].replace(" ", " \t" if i % 2 else "\n"), "en", None) for i in range(6)]
    long = text(6000)
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n", "en", "s1"), (203, "!!! 12", "en", "s1"), (204, long, "en", "s2"), (205, long + " x", "en", "s2"), (60, "same row", "en", "s1"), (60, "same row", "en", "s1"), (None, "no id", "en", "s1")]
    return out


def words(t):
    return (t or "").encode().split()


def test_mixing(spark, rows):
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    total = {s: sum(len(words(t)) for _, t, _, x in rows if x == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    budget, free, target = sum(total.values()), set(names), {}
    while True:
        left = budget - sum(3 * total[s] for s in names if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        free -= over
    target = {s: share[s] if s in free else 3 * total[s] for s in names}
    taken = dict.fromkeys(names, 0)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(words(t))) for i, t, *_ in rows)
    by_id = {i: s for i, _, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert abs(r.target - target[s]) < 1e-5 and r.source_size == total[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        biggest = max(len(words(t)) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= biggest + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_takes_rows_that_repeat_an_id_one_by_one_and_keeps_the_bound(spark):
    rows = [(None, "a b", "en", "a")] * 1000 + [(i, "", "en", "b") for i in range(60)] + [(100 + i, "c d e", "en", "b") for i in range(9)]
    rows += [(200 + i, "w " * 40, "en", "c") for i in range(50)]
    got = mixing.mix(documents(spark, rows)).collect()
    none = [r for r in got if r.doc_id is None]
    assert {r.repeats for r in none} == {0, 1} and abs(sum(r.taken for r in none) - none[0].target) <= 2
    own = [r for r in got if r.doc_id is not None and r.doc_id < 200]
    assert own[0].target == 3 * 27 and all(r.repeats == 3 for r in own)
    free = [r for r in got if r.doc_id is not None and r.doc_id >= 200]
    assert abs(sum(r.taken for r in free) - free[0].target) <= 40
    assert mixing.mixed(documents(spark, rows)).where("source = 'b' AND text = ''").count() == 180


def test_exact_groups_with_and_without_hash_collisions(spark, rows):
    docs = documents(spark, rows)
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), min(x for x in groups[norm(t)] if x is not None) if any(x is not None for x in groups[norm(t)]) else None, len(groups[norm(t)])) for i, t, *_ in rows)
    for chunk_hash in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(2))):
        got = exact.exact_groups(docs, chunk_hash).collect()
        assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    text = spark.createDataFrame([(t,) for t in ["x" * 9999, "ab " * 3000, ""]], "t string").select("t", exact.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(len(c) <= exact.MOST for c in r.c) for r in text)
    assert exact.exact_groups(docs.limit(0)).count() == 0


def plain_simhash(t):
    w = [x.decode().translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, rows):
    more = [(300 + i, rows[3][1] + f" tail{i % 3}", "en", "a") for i in range(9)] + [(320, "ÄB ab É", "de", "a"), (321, "A", "de", "a")]
    every = rows + more
    fp = [plain_simhash(t) for _, t, *_ in every]
    got = simhash.simhash_components(documents(spark, every), tile=4).collect()
    assert sorted((str(i), f"{f:016x}") for (i, *_), f in zip(every, fp, strict=True)) == sorted((str(r.doc_id), r.fingerprint) for r in got)
    ids = [i for i, *_ in every]
    label = {i: i for i in ids if i is not None}
    for _ in ids:
        for a, i in enumerate(ids):
            for b, j in enumerate(ids):
                if i is not None and j is not None and (fp[a] ^ fp[b]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(r.component_id == label.get(r.doc_id) for r in got)
    assert simhash.simhash_components(documents(spark, every).limit(0)).count() == 0


def test_fingerprint_links_find_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long"), tile=16)
    got = {r.node: r.component for r in components(links).collect()}
    label = list(range(len(fps)))
    for _ in range(10):
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(got.get(i, i) == label[i] for i in range(len(fps)))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (500, 499)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[500] == 499


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    odd = [(400, "It's 'stable <|endoftext|> Σας ﬁ²,. İ. a b _, é,", "x", "x"), (401, "é, X.\x1cY\x85z", "x", "x")]
    every = [(i if i is not None else -1, *r) for i, *r in rows + odd]
    got = packing.pack(documents(spark, every).repartition(3), window=64).collect()
    want = {}
    for i, t, *_ in every:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    seen, places = {}, set()
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
        places |= {(r.sequence_id, r.offset + k) for k in range(r.length)}
    for i, lists in want.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(seen[i], key=lambda r: r.start):
                part = np.array(lists[0][r.start : r.start + r.length], "<u4")
                assert r.start == at and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(lists[0]) and r.offset + r.length <= 64
                at += r.length
            assert at == len(lists[0])
    total = sum(len(x) for v in want.values() for x in v)
    assert len(places) == total == sum(r.length for r in got) and places == {divmod(k, 64) for k in range(total)}
    assert packing.pack(documents(spark, every).limit(0)).count() == 0


def test_substring(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)) + ". "
    passage = "".join(sentence() for _ in range(5))
    texts = {i: sentence() + sentence() + (passage if i in (3, 5, 8) else "") + sentence() for i in range(10)} | {20: None, 21: "", 22: "Short. Short. Short."}
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    texts |= {30: sentence() + long + " " + sentence(), 31: sentence() + long + " " + sentence()}
    got = {r.doc_id: r for r in substring.remove_repeats(documents(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert got[3].text == texts[3] and passage not in got[5].text and got[5].text == texts[5].replace(passage, "") and got[8].text == texts[8].replace(passage, "")
    assert got[31].words_removed > 80 and got[30].n_removed == 0
    assert all(got[i].text == texts[i] and got[i].n_removed == 0 for i in texts if i not in (5, 8, 31))
    for t in texts.values():
        cuts = substring.sentences(t or "")
        assert "".join(t[a:b] for a, b, _ in cuts) == (t or "")


def test_substring_against_hashing_every_run(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    pool = [" ".join(word() for _ in range(rng.randint(1, 15))) + rng.choice([". ", "! ", "\n"]) for _ in range(14)]
    pool.append(" ".join(word() for _ in range(70)) + " ")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["same " * 90, "same " * 90 + "end", " \n ", "x"]
    rows = [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(texts, 1)] + [(3, texts[5] + "more", "en", "s"), (3, texts[5] + "more", "en", "s"), (90, None, "en", "s")]
    docs = documents(spark, rows)
    order = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", F.hash("text").alias("k")).collect()}
    places = {}
    for (i, t), k in order.items():
        cuts = substring.sentences(t or "")
        norm = [t[a:b].lower().split() for a, b, _ in cuts]
        for a in range(len(cuts)):
            for b in range(a + 2, len(cuts) + 1):
                if sum(c[2] for c in cuts[a:b]) >= substring.WORDS:
                    places.setdefault(tuple(w for x in norm[a:b] for w in x), []).append(((i is None, i or 0, k, a), (i, t), a, b))
    lost = {key: set() for key in order}
    for found in places.values():
        for place, key, a, b in found:
            if place != min(found)[0]:
                lost[key] |= set(range(a, b))
    got = substring.remove_repeats(docs).collect()
    want = []
    for i, t, *_ in rows:
        cuts, gone = substring.sentences(t or ""), lost[i, t]
        want.append((i, t if t is None else "".join(t[a:b] for n, (a, b, _) in enumerate(cuts) if n not in gone), len(cuts), len(gone), sum(cuts[n][2] for n in gone)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and any(w[3] for w in want)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_substring_finds_short_passages_whatever_stands_around_them():
    rng = random.Random(14)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    two = lambda n: f"{some(n // 2).capitalize()}. {some(n - n // 2).capitalize()}. "

    def lost(a, b):
        """Share of the passage's words that the second text loses."""
        each = lambda x: zip(*(c.tolist() for c in substring.spans(x)), strict=True)
        known = {h for *_, h, g in each(a)}
        cuts = substring.sentences(b)
        return sum(cuts[i][2] for i in {i for at, n, h, g in each(b) if h in known for i in range(at, at + n)})

    for n in range(51, 61):
        whole = two(n)
        for head in ("Inon and. ", "A heading\n", some(20) + ". "):
            assert lost(some(12) + ". " + whole + some(9), head + whole + some(30)) == n
    for make in (some, two):
        shares = [lost(some(15) + " " + p + " " + some(15), some(20) + " " + p + " " + some(11)) / n for n in range(51, 61) for p in (make(n).strip() for _ in range(20))]
        assert np.mean([x > 0 for x in shares]) >= 0.97 and np.mean(shares) > 0.6


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    v = [b + 0.08 * rng.normal(size=16) for b in base for _ in range(9)] + list(rng.normal(size=(60, 16)))
    dense = base[0] + 0.02 * rng.normal(size=(70, 16))
    data = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate([*v, *dense, v[0], v[0]])]
    data += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, 2.0])]
    got = {r.vec_id: r for r in embeddings.near_groups(spark.createDataFrame(data, "vec_id long, embedding array<float>"), leaf=32, tile=16, k=4).collect()}
    ids = [i for i, _ in data if i < 900]
    x = np.array([e for i, e in data if i < 900])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    found, true = sum(got[i].n_links for i in ids), s.sum()
    assert found == true and all(got[i].n_links == s[k].sum() for k, i in enumerate(ids))
    label = dict(zip(ids, ids, strict=True))
    for _ in ids:
        before = dict(label)
        for k, l in zip(*np.nonzero(s), strict=True):
            label[ids[k]] = label[ids[l]] = min(label[ids[k]], label[ids[l]])
        if before == label:
            break
    assert all(got[i].component_id == label[i] for i in ids)
    assert {r.audited_recall for r in got.values()} == {1.0}
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (900, 901, 902, 903, 904))


def test_embeddings_join_components_through_a_repeated_id(spark):
    e = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    rows = [(1, e(0)), (2, e(1)), (3, e(0)), (3, e(1)), (5, e(1)), (6, e(2)), (None, e(2)), (7, e(3)), (7, e(3))]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, key string, id string")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_groups(df).collect())
    assert got == sorted([("1", 1, 1, True), ("2", 2, 1, False), ("3", 3, 1, False), ("3", 3, 1, False), ("5", 2, 1, False), ("6", 0, 6, True), ("None", 0, None, True), ("7", 0, 7, True), ("7", 0, 7, True)])
    assert embeddings.near_groups(df.limit(0)).count() == 0


def test_embeddings_find_lone_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = unit(unit(rng.normal(size=(1, 24))) + 0.15 * unit(rng.normal(size=(90, 24))))
    lone = unit(rng.normal(size=(70, 24)))
    x = np.concatenate([group, lone, unit(lone + 0.42 * unit(rng.normal(size=lone.shape)))])
    rows = [(i, [float(y) for y in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in embeddings.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), trees=1, leaf=16).collect()}
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    few = [i for i in range(len(x)) if 1 <= s[i].sum() <= 3]
    assert len(few) > 100 and np.mean([got[i].n_links / s[i].sum() for i in few]) >= 0.97
    assert all(got[i].n_links <= s[i].sum() for i in got)


def test_embeddings_cut_a_narrow_cone_where_its_vectors_differ(spark):
    rng = np.random.default_rng(13)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cone = unit(unit(rng.normal(size=(1, 24))) + 0.2 * unit(rng.normal(size=(200, 24))))
    x = np.concatenate([cone, unit(cone + 0.004 * unit(rng.normal(size=cone.shape)))])
    nodes = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    dealt = nodes.select(F.lit(0).alias("tree"), F.lit(24).alias("dim"), F.lit(0).cast("long").alias("code"), "id")
    block = {r.id: r.code for r in embeddings.narrowed(dealt, nodes, 32).collect()}
    sizes = np.unique(list(block.values()), return_counts=True)[1]
    assert len(block) == 400 and sizes.max() <= 32 and sum(block[i] == block[i + 200] for i in range(200)) > 150


@pytest.mark.parametrize("tiles, slab", [(1, 64), (1, 10_000), (4, 50), (1000, 1)])
def test_embeddings_count_links_by_tiles_and_by_slabs_alike(spark, tiles, slab):
    rng = np.random.default_rng(4)
    centres, rows = rng.normal(size=(3, 16)), []
    for component, size in ((7, 200), (8, 90), (9, 3)):
        for _ in range(size):
            v = centres[component - 7] + rng.normal(0, 0.33, 16)
            rows.append((component, len(rows), int(rng.integers(1, 4)), (v / np.linalg.norm(v)).tolist()))
    members = spark.createDataFrame(rows, "component long, id long, copies long, v array<double>").repartition(5)
    want = Counter()
    for c, i, _, v in rows:
        want[i] = sum(n for d, j, n, u in rows if c == d and i != j and np.dot(v, u) >= 0.9)
    assert 0 < sum(k > 0 for k in want.values()) and max(want.values()) > 5
    got = {r.id: r.links for r in embeddings.exact_counts(members, 0.9, 32, tiles, slab).collect()}
    assert {i: k for i, k in got.items() if k} == {i: k for i, k in want.items() if k}
    assert embeddings.exact_counts(members.limit(0), 0.9, 32, tiles, slab).collect() == []


def test_embeddings_audit_weighs_small_groups_and_exact_pass_finds_all(spark):
    assert embeddings.trees_for(2_000_000, 256, 0.9, 10) > embeddings.trees_for(2_000, 256, 0.9, 10) == 10
    rng = np.random.default_rng(12)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 60, 0), np.repeat(rng.normal(size=(20, 16)), 2, 0)])
    x += 0.01 * rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [0 if i < 60 else i for i in range(len(x))]
    nodes = spark.createDataFrame([(i, [float(y) for y in r], c) for i, (r, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, component long")
    assert embeddings.audit(nodes, len(x), 0.9) == 0
    got = {r.node: r.component for r in components(embeddings.exact_links(nodes.select("id", "v"), len(x), 0.9, slab=30)).collect()}
    assert got == {i: 0 if i < 60 else i - i % 2 for i in range(len(x))}


def test_language(spark):
    rng = random.Random(6)
    stems = {"aa": ["the", "and", "ing"], "bb": ["der", "ung", "sch"], "cc": ["que", "ent", "oux"], "dd": ["ción", "ado", "los"]}
    make = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 60)), k, "s") for i, k in enumerate(rng.choice(list(stems)) for _ in range(200))]
    rows += [(500, None, "aa", "s"), (501, "123 !?", "aa", "s"), (502, make("bb", 200_00), None, "s")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs, sample=120)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(i, k) for i, _, k, _ in rows if got[i].held_out and i < 500]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.95 * len(held)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    none = langid.predict(docs.limit(0), {"names": []})
    assert none.count() == 0 and langid.train(docs.limit(0)) == {"names": []}
    code = langid.codewords(40)
    assert len({tuple(c) for c in code}) == 40


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "to", "ri", "sel"]) for _ in range(rng.randint(1, 4)))
    rows, marks = [], []
    for i in range(400):
        t, bad = [word() for _ in range(rng.randint(5, 60))], int(rng.random() < 0.25)
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["vlgr", "blorg", "snarf"]) + rng.choice(["", "an", "to"]))
        rows.append((i, " ".join(t), "en", "s"))
        marks.append((i, 1, bad))
    rows += [(900, None, None, None), (901, "", "en", "s")]
    docs, labels = documents(spark, rows), spark.createDataFrame(marks + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(i, b) for i, _, b in marks if got[i].held_out]
    said = [i for i, _ in held if got[i].predicted]
    hit = sum(b for i, b in held if got[i].predicted)
    assert hit >= 0.85 * sum(b for _, b in held) and hit >= 0.85 * len(said)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == len(rows)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}
    assert toxicity.score(docs, labels.limit(0)).agg(F.sum("score")).first()[0] == 0


def test_urls(spark):
    given = ["http://A.Example.COM/en/x", "https://www.example.com/en/1?q=/", "http://b.net/fr/1#t", "http://b.org/en/", "no scheme", None, "http://xcom/", "ftp://net/es/", "http://u.net?x/fr/"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("b.net", "/fr/1", "net/fr/"), ("b.org", "/en/", None), ("", "", None), ("", "", None), ("xcom", "/", None), ("net", "/es/", "net/es/"), ("u.net", "", None),
    ]
    assert [got[i].verdict for i in (0, 1, 2, 7)] == ["block", "allow", "block", "block"]
    rng = random.Random(9)
    labels = [(f"http://{rng.choice(['casino', 'shop', 'news'])}.org/{rng.choice(['win', 'buy', 'read'])}/{i}",) for i in range(300)]
    labels = [(u, "block" if "casino" in u and "win" in u else "allow") for (u,) in labels]
    asked = spark.createDataFrame([(1, "http://casino.org/win/77"), (2, "http://casino.org/read/1"), (3, "http://news.org/win/1")], "page_id long, url string")
    said = {r.page_id: r.verdict for r in urls.judge(asked, rules=(), labels=spark.createDataFrame(labels, "url string, verdict string")).collect()}
    assert said == {1: "block", 2: "allow", 3: "allow"}


def test_urls_against_mining_every_subset(spark):
    rng = random.Random(19)
    make = lambda: f"http://{rng.choice(['casino', 'shop', 'news'])}.{rng.choice(['org', 'com'])}/{rng.choice(['win', 'buy', 'read'])}/{rng.choice(['a', 'b'])}?{rng.choice(['x', 'y'])}=1"
    long = "http://long.example/" + "/".join(f"s{chr(97 + i)}" for i in range(26))
    known = [make() for _ in range(300)] + [long] * 30
    said = ["block" if u == long or "casino" in u and "win" in u or rng.random() < 0.3 else "allow" for u in known]
    open_ = [make() for _ in range(60)] + [long, long + "/more", "http://long.example/sc", "http://nothing.like/it"]
    parts = lambda u: frozenset(r for r in spark_tokens[u])
    df = spark.createDataFrame([(u,) for u in {*known, *open_}], "url string")
    spark_tokens = {r.url: r.t for r in df.select("url", urls.tokens(*urls.parse(F.col("url"))).alias("t")).collect()}
    bags = [(parts(u), v) for u, v in zip(known, said, strict=True)]
    base = {v: said.count(v) / len(said) for v in ("allow", "block")}

    def best(u):
        """Verdicts of the surest rules out of every subset of a URL's tokens."""
        found = []
        pool = sorted(t for t in parts(u) if any(t in b for b, _ in bags))
        pool = pool if len(pool) < 12 else pool[:3]  # of the long URL all tokens occur together
        for mask in range(1, 1 << len(pool)):
            need = {t for k, t in enumerate(pool) if mask >> k & 1}
            hit = [v for b, v in bags if need <= b]
            for v in ("allow", "block"):
                n = hit.count(v)
                if n and n >= 0.002 * len(bags) and n / len(hit) >= 0.7 and n / len(hit) >= 1.1 * base[v]:
                    found.append((round(n / len(hit), 9), n, v))
        return {v for c, n, v in found if (c, n) == max(x[:2] for x in found)} or {"allow"}

    labels = spark.createDataFrame(list(zip(known, said, strict=True)), "url string, verdict string")
    asked = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(open_)], "page_id long, url string, tokens string")
    got = {r.page_id: r.verdict for r in urls.judge(asked, rules=(), labels=labels).collect()}
    assert all(got[i] in best(u) for i, u in enumerate(open_)) and {*got.values()} == {"allow", "block"}
    assert got[60] == got[61] == got[62] == "block" and got[63] == "allow"


def test_urls_mine_nothing_from_what_all_labels_share(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path, query = urls.parse(F.col("url"))
    rows = pages.select(urls.explicit(host, path, urls.RULES).alias("hit"), urls.tokens(host, path, query).alias("tokens")).where("hit IS NOT NULL").select("tokens", F.col("hit.verdict").alias("verdict"))
    rules = urls.mine(rows, urls.classes(rows, 0.002)).collect()
    base = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    assert rules and not any(r.kinds in (["h:example"], ["p:#"]) for r in rules)
    assert all(r.confidence >= 0.7 and r.confidence >= 1.1 * base[r.verdict] / sum(base.values()) for r in rules)
    none = urls.judge(pages.limit(0))
    assert none.count() == 0 and {r.verdict for r in urls.judge(pages, rules=()).select("verdict").distinct().collect()} == {"allow"}


def test_licenses(spark):
    page = lambda t: f"<html><title>x</title><script>MIT License</script><p>{t}</p><p>other words here</p></html>"
    data = [(1, "http://h.com/a/b/1", page("Released under the <b>MIT</b> License.")), (2, "http://h.com/a/b/2", page("plain")), (3, "http://h.com/a/c/3", page("plain")), (4, "http://h.com/a/4", page("Licensed under the Apache License, Version 2.0.")), (5, "http://g.com/x", page("my license plate")), (6, None, None), (7, "http://h.com/a/b/d/7?q", page(""))]
    got = {r.page_id: r for r in licenses.scan(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [(got[i].license, got[i].origin) for i in range(1, 8)] == [("MIT", "own"), ("MIT", "inherited"), ("Apache-2.0", "inherited"), ("Apache-2.0", "own"), (None, "none"), (None, "none"), ("MIT", "inherited")]


def test_licenses_know_usual_notices_openings_and_whole_texts(spark):
    given = {
        "Apache-2.0": 'Copyright 2020 A. Author. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "CC-BY-SA-4.0": "All texts are licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    folder = __import__("pathlib").Path(licenses.__file__).with_name("licences")
    whole = {f.stem: f.read_text() for f in sorted(folder.glob("*.txt"))}
    assert len(whole) >= 12
    filler = [("http://f.com/%d" % i, " ".join(f"w{i * k % 997}" for k in range(1, 80))) for i in range(60)]
    rows = [(f"http://n.com/{k}", f"<p>{v}</p><p>Some other paragraph of the page.</p>") for k, v in given.items()]
    rows += [(f"http://w.com/{k}/LICENSE", f"<pre>{v}</pre>") for k, v in whole.items()] + filler
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "url string, html string").withColumn("page_id", F.lit(1))).collect()}
    assert {k: got[f"n.com/{k}"] for k in given} == {k: (k, "own") for k in given}
    assert {k: got[f"w.com/{k}/LICENSE"] for k in whole} == {k: (k, "own") for k in whole}
    assert all(got[u[7:]] == (None, "none") for u, _ in filler)


def test_licenses_against_brute_force(spark):
    import regex

    rng = random.Random(23)
    templates = [("A", "licensed under the alpha license 2.0"), ("B", "this work is free for all to use under the beta terms"), ("B", "beta terms"), ("C", "alpha alpha alpha gamma")]
    pool = sorted({w for _, t in templates for w in t.split()}) + ["x", "yy", "Über"]
    block = lambda: " ".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
    pages = [(i, f"http://h.com/{'abc'[i % 3]}/{'de'[i % 2]}/{i}", [block() for _ in range(rng.randint(0, 3))]) for i in range(80)]
    pages += [(100, "http://h.com/a/d/LICENSE", [templates[1][1]]), (101, "http://h.com/a/", []), (102, "no scheme", [templates[0][1].upper()]), (103, None, None), (4, "http://h.com/b/e/4", ["x"]), (104, "http://h.com/z/y/1", ["x yy " * 3000])]
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+(?:\.\p{N}+)*", t.lower())
    units, own = [], []
    for _, _, blocks in pages:
        each = [split(b) for b in dict.fromkeys(blocks or [])]
        each += [[w for u in each for w in u]] if len(each) > 1 else []
        own.append(each)
        units += each
    words = {w for _, t in templates for w in split(t)}
    idf = {w: np.log((1 + len(units)) / (1 + sum(w in u for u in units))) + 1 for w in words}
    rare = np.log(1 + len(units)) + 1
    vec = lambda u: {w: (1 + np.log(u.count(w))) * idf[w] for w in u if w in words}
    norm = lambda v, n=0: np.sqrt(sum(x * x for x in v.values()) + n * rare * rare)

    def best(each):
        found = []
        for u in each:
            v = vec(u)
            for name, t in templates:
                k = vec(split(t))
                c = sum(x * k.get(w, 0) for w, x in v.items()) / (norm(v, sum(w not in words for w in u)) * norm(k))
                found += [(round(float(c), 6), name)] if c >= 0.75 else []
        return max(found, default=None)

    said = [best(e) for e in own]
    where = [(u or "").split("://")[-1] if u and "://" in u else "" for _, u, _ in pages]
    folder = [w[: w.rfind("/") + 1] for w in where]
    votes = {}
    for s, w, d in zip(said, where, folder, strict=True):
        if s and d:
            votes.setdefault(d, {}).setdefault(s[1], []).append(w.endswith("LICENSE"))
    declared = {d: min(v, key=lambda n: (not any(v[n]), -len(v[n]), n)) for d, v in votes.items()}
    want = []
    for (i, *_), s, w, d in zip(pages, said, where, folder, strict=True):
        ups = [d[: k + 1] for k in range(len(d)) if d[k] == "/" and d[: k + 1] in declared]
        up = max(ups, key=len, default=None)
        want.append((i, w, s[1] if s else declared.get(up), s[0] if s else None, "own" if s else "inherited" if up else "none", d if s else up))
    df = spark.createDataFrame([(i, u, None if b is None else "".join(f"<p>{x}</p>" for x in b), "c", "c") for i, u, b in pages], "page_id long, url string, html string, row string, path string")
    got = [tuple(r) for r in licenses.scan(df, templates).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {w[4] for w in want} == {"own", "inherited", "none"}
    assert licenses.scan(df.limit(0), templates).count() == 0


def test_language_decoding_against_every_codeword():
    rng = np.random.default_rng(3)
    code = langid.codewords(5)
    margins = rng.normal(size=(40, code.shape[1])) * 2
    margins[0] = 0
    which, score, unsure = langid.decode({"code": code}, margins)
    for m, w, p, u in zip(margins, which, score, unsure, strict=True):
        loss = [sum(np.log1p(np.exp(-x * c)) for x, c in zip(m, word, strict=True)) / len(m) for word in code]
        assert abs(loss[w] - min(loss)) < 1e-12 and 0 <= p <= 1
        assert u == (sorted(loss)[1] - min(loss) < 0.1)
    assert unsure[0] and not unsure.all()


def test_language_flags_a_text_between_two_languages(spark):
    rng = random.Random(7)
    stems = {"aa": ["the", "and", "ing"], "bb": ["der", "ung", "sch"], "cc": ["que", "ent", "oux"]}
    make = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 60)), k, "s") for i, k in enumerate(rng.choice(list(stems)) for _ in range(150))]
    rows += [(900 + i, make("aa", n) + " " + make("bb", 40), None, "s") for i, n in enumerate(range(30, 50))]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert any(got[900 + i].ambiguous for i in range(20)) and sum(r.ambiguous for i, r in got.items() if i < 900) <= 5


def test_toxicity_thresholds_by_language(spark):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(3000):
        lang, toxic = ("aa", "bb", "cc")[i % 3 if i % 50 else 2], int(rng.random() < 0.2)
        if lang == "cc" and i % 50:
            continue
        rows.append((i, float(rng.normal() * 0.3 + {"aa": 0, "bb": 5, "cc": 1}[lang] + 3 * toxic), lang))
        marks.append((i, toxic))
    raw, labels = spark.createDataFrame(rows, "doc_id long, z double, spoken string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    limits, every = toxicity.calibrate(raw, labels, {"fitted": [r[0] for r in rows[:200]]})
    assert 0.5 < limits["aa"] < 2.5 and 5.5 < limits["bb"] < 7.5 and set(limits) == {"aa", "bb", "cc"}
    z, w = np.arange(8.0), np.array([0, 0, 1, 0, 2, 0, 3, 0.0])
    clean = np.array([5, 4, 3, 2, 1, 1, 0, 0.0])
    share = 0.25
    f1 = [2 * h / (h + share + f) for h, f in ((share * w[k:].sum() / w.sum(), (1 - share) * clean[k:].sum() / clean.sum()) for k in range(8))]
    assert toxicity.threshold(z, w, clean, share) == z[int(np.argmax(f1))] - 0.5


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a fixture with nulls, ties and repeats: all but the classifier's own
    decisions, which are taken from its query, are worked out plainly."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
    rng = random.Random(33)
    word = lambda: "".join(rng.choice(["an", "to", "ri", "sel", "ko"]) for _ in range(rng.randint(1, 4)))
    rows, marks = [], []
    for i in range(300):
        t, bad = [word() for _ in range(rng.randint(8, 60))], int(rng.random() < 0.25)
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["vlgr", "blorg", "snarf"]))
        rows.append((i, " ".join(t), "en", f"s{i % 3}" if i % 5 else "s0"))
        marks.append((i, 1, bad))
    rows += [(400 + i, rows[i % 4][1].replace(" ", "\n" if i % 2 else "  "), "en", "s1") for i in range(12)]
    rows += [(500, None, None, None), (501, "", "en", "s1"), (501, "another text under an id that repeats", "en", "s2"), (None, "no id of its own here", "en", "s2"), (None, rows[9][1], "en", "s2"), (502, " ".join(word() for _ in range(9000)), "en", "s1")]
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    judged = toxicity.score(docs, labels).collect()
    bad = {r.doc_id for r in judged if r.predicted}
    ids = [r.doc_id for r in judged]
    stay = {(r.doc_id, r.text) for r in toxicity.accepted(docs, labels).collect()}
    left = [r for r in rows if r[:2] in stay]
    assert bad and all((r[0] not in bad) == (r[:2] in stay) for r in rows if ids.count(r[0]) == 1)
    key = lambda r: (r[0] is None, r[0] or 0, left.index(r))
    by_text = {}
    for r in sorted(left, key=key):
        by_text.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    left = list(by_text.values())
    fp, label = [plain_simhash(r[1]) for r in left], list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(a):
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    kept = {}
    for r, c in sorted(zip(left, label, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        kept.setdefault(c, r)
    left = list(kept.values())
    size = {s: sum(len(words(r[1])) for r in left if r[3] == s) for s in {r[3] for r in left}}
    got = pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(packing.default_vocabulary())
    ids_of = {(r[0], r[1]): tok.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in left}
    known = {(r[0], len(ids_of[r[0], r[1]])): r for r in left}
    assert len(known) == len(left)
    copies, places = {}, set()
    for p in got:
        r = known[p.doc_id, p.doc_tokens]
        part = np.array(ids_of[r[0], r[1]][p.start : p.start + p.length], "<u4")
        assert len(part) == p.length and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.offset + p.length <= 4096
        copies[r[0], r[1]] = copies.get((r[0], r[1]), 0) + p.length
        places |= {p.sequence_id * 4096 + p.offset + k for k in range(p.length)}
    assert places == set(range(sum(p.length for p in got))) and all(n % len(ids_of[k]) == 0 for k, n in copies.items())
    want = {r.source_size: r.target for r in mixing.mix(documents(spark, left)).select("source_size", "target").distinct().collect()}
    for s, n in size.items():
        own = [r for r in left if r[3] == s]
        times = {(r[0], r[1]): copies.get((r[0], r[1]), 0) // len(ids_of[r[0], r[1]]) for r in own}
        whole = int(want[n] // n) if n else 0
        assert set(times.values()) <= {whole, whole + 1} and max(times.values(), default=0) <= 3
        assert abs(sum(times[r[0], r[1]] * len(words(r[1])) for r in own) - want[n]) <= max(len(words(r[1])) for r in own) + 1


def test_pipeline_drops_rows_and_not_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = ("one text that stands twice here", "a text found nowhere else at all", "rows that have no id of their own")
    docs = documents(spark, [(i, t, "en", "s") for i, t in [(5, a), (3, a), (5, b), (None, c), (None, c), (None, b), (7, a)]])
    for stage in (pipeline.drop_copies, pipeline.drop_near_copies):
        left = stage(spark, docs, "")
        assert left.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("3", a), ("5", b), ("None", c)]
