"""Operators that compare or learn from whole tables, against brute force and held-out rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from chronosweep.llm import components as comp
from chronosweep.llm import decontaminate, embeddings, language, quality, queries, sharding, simhash
from tests.conftest import SMALL
from tests.llm.fixtures import LONG, ODD_TEXTS, odd_documents, rows_of

LARGER = "/root/testdata/sf0.01"


def least_of_groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, 1000 + k) for k in range(1, 400)] + [(5000 + k, 5001 + k) for k in range(200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in comp.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    links = [l for l in links if l[0] != l[1]]
    want = least_of_groups({x for l in links for x in l}, links)
    assert got == want
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash near-dedup


def fingerprint(text, words=4):
    parts = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ")
    parts = [p for p in parts if p]
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(rows, words=4):
    prints = [fingerprint(t, words) for _, t in rows]
    x = np.array(prints, "u8")
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    group = least_of_groups(range(len(rows)), zip(*np.nonzero(near), strict=True))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]].append(i)
    return Counter((i, f"{prints[k]:016x}", min(least[group[k]], default=None)) for k, (i, _) in enumerate(rows))


def as_simhash(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def test_simhash_of_odd_texts(spark):
    assert as_simhash(simhash.simhash_groups(odd_documents(spark))) == simhash_rows(ODD_TEXTS)
    assert simhash.simhash_groups(odd_documents(spark, [])).count() == 0


def test_simhash_of_all_documents(spark):
    assert as_simhash(queries.op4_simhash_near_dedup(spark, LARGER)) == simhash_rows(rows_of("documents", "doc_id, text", LARGER))


@pytest.mark.parametrize("depth", [0, 5, 7])
def test_trie_finds_all_links(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 300, dtype="u8")
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 5), dtype="u8"), axis=1)
    every = np.unique(np.concatenate([base, base ^ flips, base ^ np.uint64(1)]))
    want = {(int(a), int(b)) for a in every for b in every[np.bitwise_count(every ^ a) <= 4] if a < b}
    nodes = defaultdict(list)
    for v in every:
        nodes[int(v) >> (64 - depth)].append(v)
    got = set()
    for x in nodes:
        for y in nodes:
            if x <= y:
                a, b = np.array(nodes[x]), np.array(nodes[y])
                for i, j in simhash.trie_links(a, b, depth, 4, x == y):
                    got |= {(min(int(p), int(q)), max(int(p), int(q))) for p, q in zip(a[i], b[j], strict=True)}
    assert got == want


def test_one_copy_stays(spark):
    got = simhash.drop_near_copies(odd_documents(spark))
    assert got.columns == odd_documents(spark).columns
    ids = Counter(r["doc_id"] for r in got.collect())
    rows = simhash_rows(ODD_TEXTS, 5)
    assert sum(ids.values()) == len({c for _, _, c in rows}) and max(ids.values()) == 1


# Embedding near-dedup


def embedding_rows(rows, threshold=0.9):
    sound = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], Counter()
    for a, k in enumerate(sound):
        for m in sound[a + 1 :]:
            x, y = (np.array(rows[i][1], "f8") / np.abs(rows[i][1]).max() for i in (k, m))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((k, m))
                n[k] += 1
                n[m] += 1
    group = least_of_groups(range(len(rows)), links)
    least = {g: min(rows[k][0] for k in group if group[k] == g) for g in set(group.values())}
    return Counter((i, n[k], least[group[k]], least[group[k]] == i) for k, (i, _) in enumerate(rows))


def as_embeddings(df):
    return Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=24)
    rows = [
        (1, None), (2, []), (3, [0.0] * 24), (4, [None] * 24), (5, [float("nan")] * 24), (6, [float("inf")] + [0.0] * 23),
        (10, a.tolist()), (11, a.tolist()), (11, a.tolist()), (12, (3 * a).tolist()), (13, (-a).tolist()), (14, a[:12].tolist()),
        (15, (a + rng.normal(size=24) * 0.1).tolist()), (16, (a * 1e-200).tolist()), (17, rng.normal(size=24).tolist()),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, bucket int, n int")
    assert as_embeddings(embeddings.embedding_groups(df)) == embedding_rows(rows)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_recall_of_embedding_links(spark):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a = unit(rng.normal(size=(400, 64)))
    aside = rng.normal(size=a.shape)
    aside = unit(aside - (aside * a).sum(1)[:, None] * a)
    cos = rng.uniform(0.85, 1.0, 400)[:, None]
    x = unit(np.concatenate([a, cos * a + np.sqrt(1 - cos * cos) * aside]))
    true = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(df).collect()}
    found = np.array([got[k] for k in range(len(x))])
    assert true.sum() > 400 and (found <= true).all()
    assert found.sum() >= 0.95 * true.sum()


def test_all_embeddings(spark):
    rows = rows_of("embeddings", "vec_id, embedding", LARGER)
    assert as_embeddings(queries.op2_embedding_near_dedup(spark, LARGER)) == embedding_rows(rows)


def test_crowded_bucket_keeps_all_links(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=16)
    rows = [(k, (a + rng.normal(size=16) * 0.01).tolist()) for k in range(embeddings.BLOCK + 500)]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(len(rows) - 1, 0)}


# Benchmark decontamination


def leak_rows(documents, items):
    def shingles(text, n=5):
        words = decontaminate.words_of(text)
        k = min(n, len(words))
        return k, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()

    out = Counter()
    for doc, text in documents:
        words = decontaminate.words_of(text)
        for item, body in items:
            k, wanted = shingles(body)
            held = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
            if wanted and len(wanted & held) >= 0.8 * len(wanted):
                out[doc, item, len(wanted), len(wanted & held)] += 1
    return out


ITEM = "how many legs has a spider that lost two of them in a fight with a bird of prey near the old mill"
CHANGED = ITEM.replace("mill", "barn")
LEAKS = [*ODD_TEXTS, (30, f"{LONG} {ITEM.upper()}! {LONG}"), (31, f"before {CHANGED} after"), (32, " ".join(ITEM.split()[:9])), (33, "forty-two, indeed"), (34, ITEM)]
ITEMS = [(1, ITEM), (2, None), (3, ""), (4, "Forty two!"), (None, ITEM), (5, ITEM), (6, " ".join(LONG.split()[:400]))]


def test_size_classes():
    for n in range(1, 5000):
        s = decontaminate.size_class(n)
        assert n <= s and (s < 4 or n > 0.66 * s)


def test_items_of_all_sizes_are_found_in_long_texts():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [(k, " ".join(word() for _ in range(size))) for k, size in enumerate([*range(1, 40), 55, 80, 130, 300] * 4)]
    index, hasher = decontaminate.ItemIndex(items), decontaminate._Hasher()
    filler = lambda: [word() for _ in range(150)]
    texts = [filler() + text.split() + filler() for _, text in items]
    found = index.search(texts, hasher)
    assert sum(any(i == k for i, *_ in pairs) for k, pairs in enumerate(found)) == len(items)


def test_leaks_of_odd_texts(spark):
    items = spark.createDataFrame([(*r, "x", "y") for r in ITEMS], "item_id long, text string, doc_id string, id string")
    got = decontaminate.find_leaks(odd_documents(spark, LEAKS), items).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got) == leak_rows(LEAKS, ITEMS)
    clean = decontaminate.drop_leaks(odd_documents(spark, LEAKS), items)
    bad = {d for d, *_ in leak_rows(LEAKS, ITEMS)}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, t in LEAKS if (i not in bad or i is None))
    assert clean.columns == odd_documents(spark).columns
    assert decontaminate.find_leaks(odd_documents(spark), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(odd_documents(spark, []), items).count() == 0


# Sharding


def test_shards(spark):
    rows = rows_of("documents", "doc_id, text", LARGER)
    got = queries.op6_sharding(spark, LARGER).collect()
    size = lambda t: len(t.encode()) + 1 if t is not None else 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots, weights, home = defaultdict(list), Counter(), defaultdict(set)
    texts = dict(rows)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        weights[r["shard"]] += r["size"]
        home[texts[r["doc_id"]]].add(r["shard"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(weights.values()) - min(weights.values()) <= 0.02 * sum(weights.values()) / 8
    assert all(len(s) == 1 for s in home.values())


def test_shards_of_odd_texts(spark):
    got = sharding.shard_documents(odd_documents(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD_TEXTS)
    assert sharding.shard_documents(odd_documents(spark, [])).count() == 0


def test_a_large_group_is_split(spark):
    rows = [(k, "the same text") for k in range(900)] + [(1000 + k, f"other {k}") for k in range(300)]
    got = sharding.shard_documents(odd_documents(spark, rows), shards=4).collect()
    weights = Counter()
    for r in got:
        weights[r["shard"]] += r["size"]
    assert max(weights.values()) - min(weights.values()) <= 0.1 * sum(weights.values()) / 4


def test_repeated_rows_and_null_ids_are_split_too(spark):
    for same in (5, None):
        rows = [(same, "the same text") for _ in range(900)] + [(1000 + k, f"other {k}") for k in range(300)]
        got = sharding.shard_documents(odd_documents(spark, rows), shards=4).collect()
        weights, slots = Counter(), defaultdict(list)
        for r in got:
            weights[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert max(weights.values()) - min(weights.values()) <= 0.1 * sum(weights.values()) / 4
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_joint_balance_of_shards(spark):
    got = queries.op6_sharding(spark, LARGER).collect()
    words = {i: len((t or "").split()) for i, t in rows_of("documents", "doc_id, text", LARGER)}
    tokens, rows = Counter(), Counter()
    for r in got:
        tokens[r["shard"]] += words[r["doc_id"]]
        rows[r["shard"]] += 1
    for share in (tokens, rows):
        assert max(share.values()) - min(share.values()) <= 0.25 * sum(share.values()) / 8


# Ids of any kind


def test_leaks_with_ids_of_any_kind(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(LEAKS)], "doc_id int, text string")
    for kind in ("string", "smallint", "decimal(5,0)"):
        items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
        items = items.unionByName(items.limit(0)) if kind != "string" else items.selectExpr("coalesce(item_id, '') AS item_id", "text")
        assert decontaminate.find_leaks(docs, items).count() == sum(leak_rows([(k, t) for k, (_, t) in enumerate(LEAKS)], ITEMS).values())


# Learned operators


def test_held_out_quality(spark):
    labels = dict(rows_of("labels", "doc_id, quality", LARGER))
    got = queries.op8_quality_classifier(spark, LARGER).collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.9
    assert np.mean([s >= 0.5 for s in good]) >= 0.97


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        model = quality.fit_quality(odd_documents(spark), known)
        got = quality.score_quality(odd_documents(spark), model).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD_TEXTS)
        assert quality.keep_good(odd_documents(spark), model).columns == odd_documents(spark).columns
    assert quality.score_quality(odd_documents(spark, []), model).count() == 0


def test_held_out_languages(spark):
    lang = dict(rows_of("documents", "doc_id, lang", LARGER))
    got = queries.op10_language_id(spark, LARGER).collect()
    assert len(got) == 1000
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean(held) >= 0.97


def test_languages_of_odd_texts(spark):
    rows = [(*r, "en" if k % 2 else "de") for k, r in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, k string")
    model = language.fit_languages(df)
    got = language.predict_languages(df, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD_TEXTS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 13)} <= {"und", "en", "de"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["lang_pred"] for r in language.predict_languages(df, language.fit_languages(df.limit(0))).collect()} == {"und"}


def test_language_model_sums_to_one():
    one = language._One(["abba cab", "bac"])
    grams, _ = one.own[0]
    contexts = np.full(len(grams), 0, "u8")
    p = np.exp(one.log_p([grams], [contexts])).sum()
    assert p + one.weight[0][1][0] * (language.UNSEEN - len(grams)) / language.UNSEEN == pytest.approx(1)
