"""Operators with shuffles against brute force on small tables with hot groups, ties, nulls and repeats."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from panelloom.llm import arrays, buckets, dart_minhash, decontaminate, image_copies, repeats, shared_store, substring_dedup, suffix_dedup


def invented(seed: int, n: int) -> list[tuple[int | None, str | None]]:
    """Texts with whole copies, near copies, shared passages, one very common line, repeats of a line, null and empty ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    line, passage = text(60), text(120)
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind, body = i % 8, text(rng.randint(0, 150))
        if kind == 1:
            body = f"{body} {line}\n{text(30)}"
        elif kind == 2:
            body = passage + " " + body
        elif kind == 3 and out:
            w = (rng.choice(out)[1] or "").split(" ")
            if w:
                w[rng.randrange(len(w))] = "edit"
            body = " ".join(w)
        elif kind == 4 and out:
            body = rng.choice(out)[1] or ""
        elif kind == 5:
            body = (line[:80] + "  ") * rng.randint(1, 8) + body
        out.append((i * 3 % n, body))
    return [*out, (None, line + " " + passage), (None, line), (1, None), (2, ""), (5, out[5][1]), (5, out[5][1]), (7, passage)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1.5) for k, t in rows], "doc_id long, text string, kind string, body double")


def covered(rows, cut, size):
    """For every row, the mask of its units under windows that start in a row with a smaller id."""
    none = repeats.NO_ID
    first = {}
    for k, t in rows:
        u = cut(t)
        for s in range(len(u) - size + 1):
            w = u[s : s + size]
            first[w] = min(first.get(w, none), none if k is None else k)
    out = []
    for k, t in rows:
        u, mask = cut(t), np.zeros(len(cut(t)), bool)
        for s in range(len(u) - size + 1):
            if first[u[s : s + size]] < (none if k is None else k):
                mask[s : s + size] = True
        out.append(mask)
    return out


def test_pack_keeps_numbers():
    a, b = np.array([0, 5, 1 << 40], np.uint64), np.array([2, 3, 4], np.int64)
    x, y = repeats.unpack(repeats.pack(a, b), 2)
    assert (x == a).all() and (y.view(np.int64) == b).all()
    assert [len(c) for c in repeats.unpack(repeats.pack(a[:0], b[:0]), 2)] == [0, 0]


@pytest.mark.parametrize("flush,hot", [(500_000, 64), (40, 2)])
def test_words(spark, monkeypatch, flush, hot):
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = invented(1, 120)
    cut = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted((str(k), len(cut(t)), int(m.sum()), " ".join(w for w, x in zip(cut(t), m) if not x)) for (k, t), m in zip(rows, covered(rows, cut, 20)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_words(frame(spark, rows), target=20).collect())
    assert got == want


@pytest.mark.parametrize("flush,hot", [(500_000, 64), (200, 1)])
def test_bytes(spark, monkeypatch, flush, hot):
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = invented(2, 80)
    cut = lambda t: (t or "").encode()
    want = sorted((str(k), int(m.sum()), bytes(np.frombuffer(cut(t), np.uint8)[~m])) for (k, t), m in zip(rows, covered(rows, cut, 50)))
    got = sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect())
    assert got == want


@pytest.mark.parametrize("width,most", [(11, 500_000), (60, 30)])
def test_shelves_before_buckets(spark, monkeypatch, width, most):
    """Rows dealt to shelves and from there to buckets get the same answers."""
    for m in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(m, "deal_for", lambda docs, text: repeats.Deal(127, width))
    monkeypatch.setattr(repeats.dealt, "__defaults__", (0, most))
    rows = invented(3, 80)
    cut = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted((str(k), int(m.sum()), " ".join(w for w, x in zip(cut(t), m) if not x)) for (k, t), m in zip(rows, covered(rows, cut, 20)))
    assert sorted((str(r.doc_id), r.n_removed, r.kept) for r in substring_dedup.dedup_words(frame(spark, rows), target=20).collect()) == want
    raw = lambda t: (t or "").encode()
    want = sorted((str(k), int(m.sum()), bytes(np.frombuffer(raw(t), np.uint8)[~m])) for (k, t), m in zip(rows, covered(rows, raw, 50)))
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect()) == want


def test_parcels_are_of_one_bucket(spark):
    deal = repeats.Deal(101, 10)
    rng = np.random.default_rng(5)
    key, doc, ext = rng.integers(0, 1 << 40, 400).astype(np.uint64), rng.integers(0, 50, 400), rng.integers(1, 4, 400)
    tag, zero = np.zeros(400, np.int64), np.zeros(400, np.int64)
    body = {(int(k), int(d)): bytes([int(k) % 251]) * int(e + 3 - 1) for k, d, e in zip(key, doc, ext)}
    rows = [(to, repeats.KEYS, blob, None) for to, blob in repeats.scatter(deal.shelf(deal.of_keys(key)), [key, zero, doc, tag, zero, ext])]
    rows += [(to, kind, blob, None) for to, kind, blob in repeats.answer_rows(deal, repeats.OPEN, doc, tag, zero, ext, key)]
    for to, blob in repeats.scatter(deal.shelf(deal.of_keys(key)), [key, doc, tag, zero, ext]):
        k, d = (c.view(np.int64) for c in repeats.unpack(blob, 5)[:2])
        rows.append((to, repeats.BYTES, blob, b"".join(body[a, b] for a, b in zip(k.tolist(), d.tolist()))))
    seen = {repeats.KEYS: [], repeats.OPEN: [], repeats.BYTES: []}
    for r in repeats.dealt(spark.createDataFrame(rows, repeats.PARCEL), deal, 3, 90).collect():
        c = repeats.unpack(bytes(r.blob), 6 if r.kind == repeats.KEYS else 5)
        if r.kind == repeats.OPEN:
            assert (deal.of_docs(c[0], c[1]) == r.owner).all()
            seen[r.kind] += zip(c[4].tolist(), c[0].tolist())
        else:
            assert (deal.of_keys(c[0]) == r.owner).all()
            seen[r.kind] += zip(c[0].tolist(), c[2 if r.kind == repeats.KEYS else 1].tolist())
        if r.kind == repeats.BYTES:
            assert bytes(r.body) == b"".join(body[a, b] for a, b in zip(c[0].tolist(), c[1].tolist()))
    assert all(sorted(v) == sorted(zip(key.tolist(), doc.tolist())) for v in seen.values())


def test_texts_of_one_id_are_told_apart(spark):
    """Rows that share an id, among them very many without one, keep their own answers."""
    rng = random.Random(12)
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    base = word("a", 70)
    rows = [(1, base), (5, base + " tail"), (5, word("b", 81)), (5, None), (9, base), (9, "")]
    rows += [(None, base + f" {i}" if i % 10 == 0 else word(f"n{i}x", rng.randint(1, 70))) for i in range(600)] + [(None, None)] * 3
    cut = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted((str(k), int(m.sum()), " ".join(w for w, x in zip(cut(t), m) if not x)) for (k, t), m in zip(rows, covered(rows, cut, 50)))
    assert sorted((str(r.doc_id), r.n_removed, r.kept) for r in substring_dedup.dedup_words(frame(spark, rows)).collect()) == want
    raw = lambda t: (t or "").encode()
    want = sorted((str(k), int(m.sum()), bytes(np.frombuffer(raw(t), np.uint8)[~m])) for (k, t), m in zip(rows, covered(rows, raw, 50)))
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("target", [3, 8, 9, 33])
def test_levels_of_any_length(spark, target):
    rows = invented(11, 60)
    cut = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted((str(k), int(m.sum())) for (k, t), m in zip(rows, covered(rows, cut, target)))
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.dedup_words(frame(spark, rows), target=target).collect()) == want


def test_a_very_long_text(spark):
    """One text of half a million words, repeated in parts, beside short ones."""
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=500_000))
    part = long.split(" ")[1000:1100]
    rows = [(1, long), (2, " ".join(part)), (3, "x " * 30 + " ".join(part[:60])), (4, "clean " * 10)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_words(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 100, 3: 60, 4: 0}
    assert {r.doc_id: r.class_id for r in dart_minhash.near_classes(spark, frame(spark, [*rows, (9, long + " end")])).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 9: 1}
    items = spark.createDataFrame([(7, " ".join(part[:30]))], "item_id long, text string")
    assert {r.doc for r in decontaminate.leaks(spark, frame(spark, rows), items).collect()} == {1, 2, 3}


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert substring_dedup.dedup_words(none).count() == 0 and suffix_dedup.dedup_bytes(none).count() == 0
    assert dart_minhash.near_classes(spark, none).count() == 0
    assert decontaminate.leaks(spark, none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_suffix_sort_sorts():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 900).astype(np.uint8)
    pos = np.arange(0, 800)
    s = suffix_dedup.Suffixes(buf, 50)
    perm = s.sort(pos, np.zeros(len(pos), np.int64), np.full(len(pos), len(pos)))
    keys = [buf[p : p + 50].tobytes() for p in pos[perm]]
    assert keys == sorted(keys)


def test_hash_collisions_are_caught(monkeypatch):
    """With hashes that never differ, classes still follow the bytes."""
    monkeypatch.setattr(suffix_dedup.Suffixes, "common", lambda self, a, b: np.full(len(a), self.most))
    buf = np.frombuffer(b"abcabdabc", np.uint8)
    got = suffix_dedup.classes(buf, np.array([0, 3, 6]), np.zeros(3, np.int64), 3)
    assert got[0] == got[2] != got[1]


def bags_of(rows):
    """(document, shingles) of every text; a null id is told apart by its text."""
    out = []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if w:
            out.append(((k, "") if k is not None else (buckets.NO_ID, t), collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))))
    return out


def plain_classes(rows):
    """The smallest document of each document's class, over all pairs."""
    root = {k: k for k in [(k, "") if k is not None else (buckets.NO_ID, t or "") for k, t in rows]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = bags_of(rows)
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            both = sum((x & y).values())
            if both and both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


def test_near_classes(spark):
    rows = invented(3, 160)
    want = plain_classes(rows)
    known = lambda k: None if k == buckets.NO_ID else k
    got = collections.Counter((r.doc_id, r.class_id) for r in dart_minhash.near_classes(spark, frame(spark, rows)).collect())
    assert got == collections.Counter((k, known(want[(k, "") if k is not None else (buckets.NO_ID, t or "")][0])) for k, t in rows)
    kept = dart_minhash.one_of_each(spark, frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kind", "body"]
    kept = kept.collect()
    leads = {k for k, v in want.items() if k == v}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(k for k, _ in leads if k != buckets.NO_ID)
    assert {r.text for r in kept if r.doc_id is None} == {t for k, t in leads if k == buckets.NO_ID}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, word("a", 40)), (None, word("a", 40)), (None, word("b", 40)), (None, word("b", 40)), (None, word("c", 40)), (None, None), (None, None)]
    kept = dart_minhash.one_of_each(spark, frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, word("b", 40)), (0, word("c", 40)), (1, word("a", 40))]


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_large_and_small_sides_give_the_same(spark, monkeypatch, most):
    """Ids that are too many to be sent to every executor are joined by shuffling."""
    monkeypatch.setattr(buckets.within, "__defaults__", (most,))
    rows = invented(9, 60)
    want = plain_classes(rows)
    got = {r.doc_id for r in dart_minhash.one_of_each(spark, frame(spark, rows)).collect()}
    assert got - {None} == {k for (k, t), v in want.items() if (k, t) == v} - {buckets.NO_ID}


@pytest.mark.parametrize("part", [256, 2])
def test_pairs_of_one_bucket_are_compared(spark, monkeypatch, part):
    """Pairs that share one bucket only: two nodes unlike its leader, and a node like an inner one alone."""
    monkeypatch.setattr(buckets, "PART", part)
    word = lambda k, lo, hi: " ".join(f"{k}{i}" for i in range(lo, hi))
    bucket = {
        0: [(1, word("a", 0, 60)), (2, word("b", 0, 60)), (3, word("b", 0, 60) + " end"), (4, word("c", 0, 60))],
        1: [(11, word("d", 0, 100)), (12, word("d", 10, 110)), (13, word("d", 20, 120)), (14, word("e", 0, 50))],
    }
    rows = [(k, t) for docs in bucket.values() for k, t in docs]
    bands = spark.createDataFrame([(k, [900 + b] + [k * 100 + i for i in range(1, dart_minhash.BANDS)]) for b, docs in bucket.items() for k, _ in docs], "doc long, bands array<long>")
    sketch = dart_minhash.sketch
    monkeypatch.setattr(dart_minhash, "sketch", lambda *args: sketch(*args).drop("bands").join(bands, "doc").select("doc", "alt", "own", "d1", "d2", "bands"))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_classes(spark, frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 11: 11, 12: 11, 13: 11, 14: 14}


def test_signatures_agree_as_often_as_weights_do():
    """Edited copies, and texts that differ in how often they repeat their shingles."""
    import pyarrow as pa

    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    edited = list(base)
    for i in rng.sample(range(400), 12):
        edited[i] = "edit"
    loop = lambda n: ("a b c d e " * n).strip()
    texts = [" ".join(base), " ".join(edited), "one two", *(loop(n) for n in (40, 50, 100))]
    block = next(arrays.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    row, shingle, weight = dart_minhash.weights(block)
    sig, have = dart_minhash.signatures(row, shingle, weight, len(texts))
    bag = [dict(zip(shingle[row == i].tolist(), weight[row == i].tolist())) for i in range(len(texts))]
    assert have.all() and max(weight) > 90
    for i, j in [(0, 1), (3, 4), (4, 5), (0, 3)]:
        keys = set(bag[i]) | set(bag[j])
        low, high = (sum(f(bag[i].get(k, 0), bag[j].get(k, 0)) for k in keys) for f in (min, max))
        assert abs((sig[i] == sig[j]).mean() - low / high) < 0.16, (i, j)


def local_score(text, item):
    h = np.zeros((len(text) + 1, len(item) + 1), int)
    for i in range(1, len(text) + 1):
        for j in range(1, len(item) + 1):
            s = decontaminate.MATCH if text[i - 1] == item[j - 1] else decontaminate.MISS
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(5)
    n, m = rng.integers(1, 30, 40), rng.integers(1, 15, 40)
    t, q = rng.integers(0, 5, (40, 30)).astype(np.uint64), rng.integers(0, 5, (40, 15)).astype(np.uint64)
    best, _ = decontaminate.smith_waterman(t, n, q, m)
    assert best.tolist() == [local_score(t[i, : n[i]], q[i, : m[i]]) for i in range(40)]


def test_leaks(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, text(30)) for i in range(6)] + [(None, text(30)), (8, None), (9, ""), (10, "two words")]
    edited = items[1][1].split(" ")
    edited[4:6], edited[15] = ["other"], "changed"
    docs = [(1, text(50) + " " + items[0][1].upper() + ", " + text(50)), (2, text(80) + " " + " ".join(edited) + text(20)), (3, text(200)), (4, None), (5, ""), (None, items[2][1])]
    docs += [(100 + i, items[3][1]) for i in range(30)] + [(300, "Two words!"), (301, "so two words more"), (302, "two"), (None, "a clean text without an id")]
    got = decontaminate.leaks(spark, frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(1, 0), (2, 1), (buckets.NO_ID, 2)} | {(100 + i, 3) for i in range(30)} | {(300, 10)}
    assert {(r.doc, r.item_id) for r in got} == want
    kept = decontaminate.without_leaks(spark, frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 301, 302]


def test_leaks_of_an_item_s_frequent_part(spark):
    """Many documents with the first 18 of 40 words (0.45 of the best score), few with all."""
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    item = word("q", 40)
    docs = [(i, word(f"d{i}x", 30) + " " + " ".join(item.split(" ")[:18])) for i in range(30)] + [(100 + i, item) for i in range(3)] + [(200, word("z", 60)), (201, "q0 q1 q2 " + word("y", 40))]
    got = decontaminate.leaks(spark, frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc, r.score) for r in got} == {(i, 0.45) for i in range(30)} | {(100 + i, 1.0) for i in range(3)}


def test_leaks_equal_all_pairs_aligned(spark):
    """Items of 3 to 60 words in texts with none to half of their words replaced, dropped or followed by others: every pair that scores enough is found, and no other."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)]
    draw = lambda n: [vocabulary[min(int(rng.expovariate(0.03)), 459)] for _ in range(n)]
    items = {k: draw(n) for k, n in enumerate([3, 4, 5, 5, 8, 8, 12, 15, 20, 30, 45, 60])}
    texts = {}
    for k, words in items.items():
        for share in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5):
            for way in range(4):
                out = []
                for i, w in enumerate(words):
                    hit = rng.random() < share if way else i % 3 == 2 and share > 0
                    kind = way if way < 3 else rng.randrange(3)
                    out += ([w] if not hit else draw(1) if kind < 2 else []) + (draw(1) if hit and kind == 1 and rng.random() < 0.5 else [])
                texts[len(texts) + 1000] = draw(rng.randrange(8)) + out + draw(rng.randrange(8))
    for _ in range(40):
        texts[len(texts) + 1000] = draw(rng.randrange(1, 120))
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    got = {(r.doc, r.item_id): r.score for r in decontaminate.leaks(spark, frame(spark, rows), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()}
    code = {w: i + 1 for i, w in enumerate(vocabulary)}
    want = {}
    for k, w in items.items():
        q = np.array([code[x] for x in w], np.uint64)
        n = np.array([len(t) for t in texts.values()])
        t = np.zeros((len(texts), n.max()), np.uint64)
        for z, x in enumerate(texts.values()):
            t[z, : n[z]] = [code[y] for y in x]
        best, _ = decontaminate.smith_waterman(t, n, np.tile(q, (len(texts), 1)), np.full(len(texts), len(q)))
        want |= {(d, k): b / (decontaminate.MATCH * len(q)) for d, b in zip(texts, best.tolist()) if b / (decontaminate.MATCH * len(q)) >= decontaminate.LEAST}
    assert len(want) > 250 and got == want


def test_seeds_leave_out_what_is_in_every_document(spark):
    """A pair of words in all documents and half of the items joins nothing where an item can do without it."""
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    items = spark.createDataFrame([(i, f"of the {word(f'q{i}x', 12)} of the") for i in range(20)] + [(i + 20, word(f"r{i}x", 12)) for i in range(20)], "item_id long, text string")
    docs = frame(spark, [(i, f"of the {word(f'd{i}y', 30)} of the") for i in range(50)])
    rows = decontaminate.item_rows(items)
    counts = decontaminate.document_counts(docs, rows.selectExpr("explode(grams) AS gram"), 2000, "text")
    assert counts.selectExpr("max(docs)").first()[0] == 50
    seeds = decontaminate.seeds_of(rows, counts, decontaminate.LEAST)
    assert decontaminate.seed_hits(docs, seeds, 2000, "text", "doc_id").join(seeds, "gram").count() == 0
    assert decontaminate.leaks(spark, docs, items).count() == 0


def image_frame(spark, rows):
    return spark.createDataFrame([(k, None if p is None else p if isinstance(p, bytes) else image_copies.to_pgm(p), "x", 2) for k, p in rows], "page_id long, image binary, corners string, node int")


def classes_of(spark, rows):
    return [(r.page_id, r.class_id) for r in image_copies.copy_classes(spark, image_frame(spark, rows), "page_id").collect()]


def edited(rng, p, most=5):
    return np.clip(p.astype(int) + rng.integers(-most, most + 1, p.shape), 0, 255).astype(np.uint8)


def test_image_copies(spark):
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 256, (60 + 4 * i, 64)).astype(np.uint8) for i in range(12)]
    rows = list(enumerate(base)) + [(100 + i, p) for i, p in enumerate(base[:4])]
    rows += [(200 + i, edited(rng, p)) for i, p in enumerate(base[4:8])] + [(300 + i, p[8:]) for i, p in enumerate(base[8:])]
    rows += [(400, None), (401, b"P5 9"), (402, b""), (None, base[0]), (None, base[0]), (None, rng.integers(0, 256, (50, 50)).astype(np.uint8)), (5, base[1]), (500, b"P5 -2 -3 255\n123456")]
    rows += [(600 + i, image_copies.halved(p)) for i, p in enumerate(base[:4])] + [(700 + i, np.rot90(p)) for i, p in enumerate(base[4:8])] + [(800 + i, p[20:60, 10:50]) for i, p in enumerate(base[8:])]
    got = classes_of(spark, rows)
    want = {**{i: i for i in range(12)}, **{100 + i: i for i in range(4)}, **{200 + i: 4 + i for i in range(4)}, **{300 + i: 8 + i for i in range(4)}, **{k: k for k in (400, 401, 402, 500)}}
    want |= {**{600 + i: i for i in range(4)}, **{700 + i: 4 + i for i in range(4)}, **{800 + i: 8 + i for i in range(4)}}
    # id 5 has two contents, which are of one class with all copies of both
    want |= {k: 1 for k in (5, 201, 701)}
    assert {k: c for k, c in got if k is not None} == want
    assert sorted((c for k, c in got if k is None), key=str) == [0, 0, None]
    assert classes_of(spark, []) == []


def test_copies_among_images_that_share_their_parts(spark):
    """An image of ten bands, each from another image, and its edited copy, are one class whatever else holds the bands."""
    rng = np.random.default_rng(8)
    source = [rng.integers(0, 256, (100, 64)).astype(np.uint8) for _ in range(10)]
    bands = np.concatenate([p[10 * i : 10 * i + 10] for i, p in enumerate(source)])
    copy = bands.copy()
    copy[[5, 33, 71], [7, 20, 50]] ^= 128
    rows = list(enumerate(source)) + [(50, bands), (51, copy)]
    assert dict(classes_of(spark, rows)) == {**{i: i for i in range(10)}, 50: 50, 51: 50}


@pytest.mark.parametrize("part", [256, 3])
def test_images_are_compared_like_all_pairs(spark, monkeypatch, part):
    """Images with a common border, copies, crops and collages, against every pair compared."""
    monkeypatch.setattr(buckets, "PART", part)
    rng = np.random.default_rng(9)
    border = rng.integers(0, 256, (14, 40)).astype(np.uint8)
    body = [rng.integers(0, 256, (int(rng.integers(20, 70)), 40)).astype(np.uint8) for _ in range(24)]
    images = [np.concatenate([border, p]) for p in body] + [np.concatenate([border, edited(rng, p, 4)]) for p in body[:8]] + [p[: len(p) * 3 // 4] for p in body[8:14]]
    images += [np.concatenate([border, body[i][:18], body[i + 1][:18], body[i + 2][:18]]) for i in range(14, 20)]
    found = []
    for p in images:
        found.append(image_copies.entered(image_copies.describe([p])[1]))
    words = [image_copies.table_words(c) for c in found]
    root = list(range(len(images)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(images)):
        for j in range(i):
            common = len(np.intersect1d(words[i], words[j])) >= max(1, image_copies.SHARE * min(len(words[i]), len(words[j])))
            votes = image_copies.agreeing(found[j], found[i])
            if common and votes >= image_copies.LEAST_VOTES and votes >= image_copies.LEAST_SHARE * min(len(found[i]), len(found[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert dict(classes_of(spark, list(enumerate(images)))) == {i: find(i) for i in range(len(images))}


def recall(pairs):
    hit = 0
    for p, q in pairs:
        a, b = (image_copies.entered(image_copies.describe([x])[1]) for x in (p, q))
        wa, wb = image_copies.table_words(a), image_copies.table_words(b)
        votes = image_copies.agreeing(a, b)
        hit += len(np.intersect1d(wa, wb)) >= max(1, image_copies.SHARE * min(len(wa), len(wb))) and votes >= image_copies.LEAST_VOTES and votes >= image_copies.LEAST_SHARE * min(len(a), len(b))
    return hit / len(pairs)


def test_recall_of_crops_edits_and_scales():
    rng, pick = np.random.default_rng(0), random.Random(1)
    vocabulary = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(3000)]
    noise = [rng.integers(0, 256, (90, 64)).astype(np.uint8) for _ in range(60)]
    for change in (lambda p: edited(rng, p), image_copies.halved, np.rot90, lambda p: p[8:], lambda p: p[20:60, 10:50]):
        assert recall([(p, change(p)) for p in noise]) >= 0.9
    assert recall(list(zip(noise, noise[1:]))) == 0

    def page():
        out = []
        for _ in range(5):
            w = pick.choices(vocabulary, k=pick.randint(25, 60))
            for i in range(pick.randint(6, 12), len(w), 11):
                w[i] += "."
            out.append(" ".join(w))
        return out

    def one_word(paragraphs):
        out = []
        for p in paragraphs:
            w = p.split(" ")
            w[pick.randrange(len(w))] = pick.choice(vocabulary)
            out.append(" ".join(w))
        return out

    image = lambda p: image_copies.parse_pgm(image_copies.render("\n".join(p)))
    pages = [page() for _ in range(100)]
    for change in (lambda p: p[:2], lambda p: p[3:], one_word, lambda p: ["extra " + p[0], *p[1:]]):
        assert recall([(image(p), image(change(p))) for p in pages]) >= 0.9


def test_pgm_headers():
    read = image_copies.parse_pgm
    assert read(b"P5\n# made by hand\n2 1\n# more\n255\n\x01\x02").tolist() == [[1, 2]]
    assert read(b"P5 2 1 65535 \xff\xff\x00\x00").tolist() == [[255, 0]]
    assert read(b"P5 2 1 15\n\x0f\x00").tolist() == [[255, 0]]
    assert read(b"P5 " + b" " * 100 + b"1 1 255\n\x07").tolist() == [[7]]
    assert [read(x) for x in (b"P5 -2 -3 255\n123456", b"P5 0 3 255\n", b"P5 2 2 255\n123", b"P2 1 1 255\n1", b"", None, b"P5 99999999999 99999999999 255\n1")] == [None] * 7


def test_a_tall_image_is_described_in_strips(monkeypatch):
    p = np.random.default_rng(3).integers(0, 256, (500, 30)).astype(np.uint8)
    whole = image_copies.describe([p])[1]
    monkeypatch.setattr(image_copies, "STRIP", 64)
    assert sorted(image_copies.describe([p])[1].tolist()) == sorted(whole.tolist())


@pytest.mark.parametrize("remove", [suffix_dedup.dedup_bytes, substring_dedup.dedup_words])
def test_texts_are_dealt_once_for_both_steps(spark, remove):
    phrase = " ".join(f"w{i}" for i in range(60))
    out = remove(spark.createDataFrame([(i, f"{i} {phrase} {'x' * i}") for i in range(6)], "doc_id long, text string"))
    assert out.where("n_removed > 0").count() == 5
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [_owner" in plan and plan.count("ReusedExchange") == 1


def test_screen_loses_no_pair_at_the_bound():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(20, 401))
        need = int(np.ceil(image_copies.SHARE * n))
        common = rng.integers(0, 1 << 63, need, np.uint64)
        sides = [np.unique(np.r_[common, rng.integers(0, 1 << 63, n - need, np.uint64)]) for _ in range(2)]
        content = {"shorts": [np.sort(w.astype(np.uint16)).tobytes() for w in sides]}
        assert image_copies.screen(content, np.array([0]), np.array([1]), np.ones((1, 1), bool)).all()
    assert image_copies.told_apart(np.array([3, 3, 3, 9], np.uint16)).tolist() == [3, 3 | 1 << 16, 3 | 2 << 16, 9]


def test_shifts_on_an_edge_both_ways_agree():
    rng = np.random.default_rng(6)
    a = np.zeros(40, image_copies.CORNER)
    a["bits"], a["y"], a["x"] = rng.integers(0, 1 << 63, 40, np.uint64), rng.integers(100, 900, 40), rng.integers(100, 900, 40)
    b = a.copy()
    b["y"], b["x"] = a["y"] + 8 - np.arange(40) % 2, a["x"] + 4 - np.arange(40) // 2 % 2
    assert image_copies.agreeing(a, b) == 40


def test_no_corner_is_left_out():
    c = np.zeros(300, image_copies.CORNER)
    c["bits"] = np.random.default_rng(7).integers(0, 1 << 63, 300, np.uint64)
    assert len(image_copies.entered(c)) == 300 and len(image_copies.table_words(c)) == 300 * image_copies.WORDS
    assert len(image_copies.entered(c, 3)) < 300


def test_image_copies_write_no_rows_for_shared_words(spark, monkeypatch):
    """Images that share a border, but are no copies: what is written does not grow with the words or pairs that they share."""
    rng = np.random.default_rng(10)
    border = rng.integers(0, 256, (14, 40)).astype(np.uint8)
    rows = [(i, np.concatenate([border, rng.integers(0, 256, (50, 40)).astype(np.uint8)])) for i in range(40)]
    written, keep = {}, shared_store.Scratch.keep

    def counting(self, df, name):
        table = keep(self, df, name)
        written[name] = table.count()
        return table

    monkeypatch.setattr(shared_store.Scratch, "keep", counting)
    assert classes_of(spark, rows) and max(written.values()) <= len(rows), written


@pytest.mark.parametrize("frequent, match", [(1 << 14, 1 << 20), (0, 1 << 20), (40, 100)])
@pytest.mark.parametrize("most", [1, 7, 100])
def test_blocks_of_any_size_give_the_classes_of_all_pairs(monkeypatch, most, frequent, match):
    monkeypatch.setattr(image_copies, "FREQUENT", frequent)
    monkeypatch.setattr(image_copies, "MATCH", match)
    rng = np.random.default_rng(11)
    border = rng.integers(0, 256, (14, 40)).astype(np.uint8)
    body = [rng.integers(0, 256, (int(rng.integers(20, 60)), 40)).astype(np.uint8) for _ in range(14)]
    images = [np.concatenate([border, p]) for p in body] + [edited(rng, p, 4) for p in body[:5]] + [p[: len(p) * 3 // 4] for p in body[5:9]] + [border]
    images += [np.concatenate([border, body[i][:18], body[i + 1][:18]]) for i in range(9, 13)]
    found = [image_copies.describe([p])[1] for p in images]
    words = [image_copies.table_words(c) for c in found]
    want = {i: i for i in range(len(found))}
    for j in range(len(found)):
        for i in range(j):
            votes = image_copies.agreeing(found[i], found[j])
            if len(np.intersect1d(words[i], words[j])) >= max(1, image_copies.SHARE * min(len(words[i]), len(words[j]))) and votes >= max(image_copies.LEAST_VOTES, image_copies.LEAST_SHARE * min(len(found[i]), len(found[j]))):
                x, y = sorted((image_copies.root_of(want, i), image_copies.root_of(want, j)))
                want[y] = x
    blocks = []
    for lo in range(0, len(found), most):
        part = found[lo : lo + most]
        blocks.append(image_copies.Block(np.arange(lo, lo + len(part)).tobytes(), np.array([len(c) for c in part], np.int32).tobytes(), image_copies.pack(np.concatenate(part))))
    root = {}
    links = [x for i, a in enumerate(blocks) for b in blocks[: i + 1] for x in image_copies.block_links(a, b, a is b, root)]
    classes = [image_copies.root_of(want, i) for i in range(len(found))]
    assert [image_copies.root_of(root, i) for i in range(len(found))] == classes
    assert len(links) == len(found) - len(set(classes)) > 5


def test_open_segments_do_not_grow_with_the_text(spark):
    """Unrelated texts of few words: hardly a segment has to be compared byte by byte, however many texts there are."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(20)]
    docs = frame(spark, [(i, " ".join(rng.choices(words, k=600))) for i in range(300)])
    deal = repeats.Deal(127, 1)
    rows = repeats.prepared(shared_store.Scratch(spark), docs, deal, "text", "doc_id")
    sent = repeats.send_segments(rows, deal, suffix_dedup.byte_units, 50, suffix_dedup.SEED, suffix_dedup.BLOCK)
    count = lambda df, *kinds: sum(int(np.frombuffer(r.blob, np.int64, 1)[0]) for r in df.where(repeats.F.col("kind").isin(*kinds)).collect())
    assert count(repeats.exchange(sent, deal, True, repeats.COVERED), repeats.OPEN, repeats.OPEN_HOT) < 0.01 * count(sent, repeats.KEYS)


@pytest.mark.parametrize("target,seed", [(50, 32), (50, 16), (50, 7), (20, 12), (9, 2), (4, 4)])
def test_seeds_follow_the_window(target, seed):
    """Equal windows have equal seeds at equal places, inside the window, and the segments are those of the seeds."""
    units = np.random.default_rng(22).integers(0, 3, 400).astype(np.uint64)
    units = np.r_[units, units[5:305], units[17:317]]
    u = repeats.Units(units, np.array([0, len(units)]))
    starts = np.arange(len(units) - target + 1)
    place = repeats.seeds_of(u, arrays.prefix(units), starts, target, seed) - starts
    assert 0 <= place.min() and place.max() <= target - seed
    seen = {}
    assert all(seen.setdefault(units[s : s + target].tobytes(), p) == p for s, p in zip(starts.tolist(), place.tolist()))
    s = repeats.segments(u, target, seed)
    assert s.count.sum() == len(starts) and s.count.max() <= target - seed + 1
    assert (np.repeat(s.seed, s.count) == starts + place).all()


def test_long_seeds_make_few_segments():
    units = np.random.default_rng(23).integers(0, 256, 50_000).astype(np.uint64)
    assert len(repeats.segments(repeats.Units(units, np.array([0, len(units)])), 50, suffix_dedup.SEED).row) < len(units) / 12


@pytest.mark.parametrize("target", [1, 3, 17, 33, 70])
def test_bytes_of_any_length(spark, target):
    rows = invented(24, 40)
    raw = lambda t: (t or "").encode()
    want = sorted((str(k), int(m.sum()), bytes(np.frombuffer(raw(t), np.uint8)[~m])) for (k, t), m in zip(rows, covered(rows, raw, target)))
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(frame(spark, rows), target=target).collect()) == want


def test_windows_in_a_row_are_one_answer():
    deal = repeats.Deal(127, 1)
    # two segments of five windows of ten bytes, seed at the sixth byte; the last byte differs
    columns = [np.array([9, 9], np.uint64), np.array([1, 2]), np.array([0, 0]), np.array([40, 60]), np.array([5 * 11 + 5, 5 * 11 + 5])]
    rows = suffix_dedup.judge_bytes(repeats.pa.chunked_array([[repeats.pack(*columns)]]), b"0123456789abcd0123456789abcX", deal, 10)
    assert len(rows) == 1
    doc, _, pos, ext, _ = (c.view(np.int64).tolist() for c in repeats.unpack(rows[0][2], 5))
    assert (doc, pos, ext) == ([2], [60], [4])
