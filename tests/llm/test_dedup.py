"""Substring dedup, near-duplicates, decontamination and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cases import frame, prose, shingles, texts, words
from dealsift.llm import components, decontaminate, near_dedup, substring

BIG = 2**63 - 1


def removed(rows, window=13):
    """Kept words of every row, by the definition."""
    least = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            least[key] = min(least.get(key, BIG), BIG if i is None else i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s:s + window])] < (BIG if i is None else i):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_substring_is_the_definition(spark, documents):
    got = rows_of(substring.remove_repeats(documents).drop("kept"))
    assert got == sorted(removed(texts()), key=str)
    assert sum(r[2] for r in got) > 1000


def test_substring_does_not_depend_on_chunks(spark, documents):
    many = substring.remove_repeats(documents, chunk_bytes=2000, bucket_bytes=1500).drop("kept")
    assert rows_of(many) == sorted(removed(texts()), key=str)


def test_substring_rewrites_only_what_loses_words(spark, documents):
    out = substring.remove_repeats(documents, rewrite=True)
    assert out.columns == documents.columns and out.count() == documents.count()
    lost = {(i, h): n for i, _, n, h in removed(texts())}
    before = Counter(r.text for r in documents.collect())
    for r in out.collect():
        assert before[r.text] or lost[r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()] > 0


def test_substring_empty(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def linked(rows):
    """Component (smallest id) of every row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    ids = [BIG if i is None else i for i, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for x in range(len(rows)):
        least[root(x)] = min(least.get(root(x), BIG), ids[x])
    out = []
    for x, (i, _) in enumerate(rows):
        c = least[root(x)]
        out.append((i, len(sets[x]), i if c == BIG else c, ids[x] == c))
    return out


def test_near_duplicates_are_all_found(spark, documents):
    got = rows_of(near_dedup.dedup(documents))
    assert got == sorted(linked(texts()), key=str)
    assert sum(not r[3] for r in got) > 10


def test_near_duplicates_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    assert rows_of(near_dedup.dedup(documents)) == sorted(linked(texts()), key=str)


def test_keep_first_keeps_one_of_a_group(spark, documents):
    out = near_dedup.keep_first(documents)
    assert out.columns == documents.columns
    kept = {r[0] for r in linked(texts()) if r[3]}
    got = Counter(r.doc_id for r in out.collect())
    assert set(got) == kept and got[8] == 0 and got[7] == 1 and all(n == 1 for n in got.values())


def near(text, k):
    return text.replace(" ", f" x{k} ", 1)


def test_texts_that_share_an_id_do_not_link_their_neighbours(spark):
    one, two, three, four = (prose(900 + k, 200) for k in range(4))
    rows = [(7, one), (50, two), (None, near(one, 31)), (None, near(two, 32)), (None, prose(910, 80)),
            (60, three), (70, four), (99, near(three, 33)), (99, near(four, 34)), (99, prose(911, 80))]
    table = frame(spark, rows)
    got = rows_of(near_dedup.dedup(table))
    assert got == sorted(linked(rows), key=str)
    assert {r[0] for r in got if r[3]} == {7, 50, None, 60, 70, 99}
    assert Counter(r.text for r in near_dedup.keep_first(table).collect()) == Counter([one, two, prose(910, 80), three, four, prose(911, 80)])


def test_near_texts_without_id_leave_one(spark):
    one = prose(920, 200)
    rows = [(None, one), (None, near(one, 35)), (None, near(one, 36)), (None, prose(921, 200))]
    assert len(near_dedup.keep_first(frame(spark, rows)).collect()) == 2


def test_near_duplicates_empty(spark):
    assert near_dedup.dedup(frame(spark, [])).count() == 0
    assert near_dedup.keep_first(frame(spark, [(1, None), (1, None)])).count() == 2


def test_signatures_within_the_distance_share_a_key():
    pick = np.random.default_rng(3)
    for _ in range(300):
        a = pick.integers(0, 65536, near_dedup.HASHES).astype(np.uint16)
        b = a.copy()
        at = pick.choice(near_dedup.HASHES, 2 * near_dedup.BANDS - 1, replace=False)
        b[at] += pick.integers(1, 65536, len(at)).astype(np.uint16)
        keys = near_dedup._chunk_keys(np.stack([a, b]))
        common = np.flatnonzero(keys[0] == keys[1])
        assert len(common) and common[0] == near_dedup._first_key((a == b)[None, :])[0]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_any_shape(spark, seed):
    pick = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(pick.randrange(200, 260), pick.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_is_brute_force(spark):
    pick = random.Random(5)
    items = [(k, prose(500 + k, 20 + k)) for k in range(12)] + [(90, None), (91, "too short"), (92, "")]
    docs = [(None, prose(1, 50) + " " + items[0][1]), (1, None), (2, ""), (3, items[1][1]), (3, items[1][1]), (4, items[2][1].upper()), (5, " ".join(items[3][1].split()[:-2]))]
    for k in range(40):
        w = items[k % 12][1].split()
        for _ in range(pick.randrange(0, 4)):
            w[pick.randrange(len(w))] = f"edit{k}"
        docs.append((100 + k, prose(600 + k, 60) + " " + " ".join(w) + " " + prose(700 + k, 30)))
    for k in range(40):  # insertions, deletions and moved parts
        w = items[k % 12][1].split()
        at = pick.randrange(len(w))
        if k % 4 == 0:
            w[at:at] = [f"new{k}_{j}" for j in range(pick.randrange(1, 5))]
        elif k % 4 == 1:
            del w[at:at + pick.randrange(1, 4)]
        elif k % 4 == 2:
            w = w[at:] + w[:at]
        else:
            w[:2], w[at:at] = [f"cut{k}"], [f"in{k}", f"more{k}"]
        docs.append((400 + k, prose(1600 + k, 30) + " " + " ".join(w) + " " + prose(1700 + k, 30)))
    docs += [(200 + k, prose(800 + k, 100)) for k in range(10)] + [(300, prose(9, 20_000, 5000) + " " + items[5][1])]
    expected = set()
    for i, text in docs:
        theirs = words((text or "").lower())
        sh = [tuple(theirs[s:s + 5]) for s in range(len(theirs) - 4)]
        for k, item in items:
            own = words((item or "").lower())
            mine = Counter(tuple(own[s:s + 5]) for s in range(len(own) - 4))
            for s in range(max(1, len(sh) - len(own) + 5)) if mine and set(sh) & set(mine) else ():
                x = Counter(sh[s:s + len(own) - 4])
                if 4 * sum((x & mine).values()) >= 3 * sum((x | mine).values()):
                    expected.add((i, k))
    table, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(table, bench).collect()}
    assert got == expected and len(expected) > 10
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(table, bench, broadcast_bytes=20_000).collect()} == expected
    left = decontaminate.remove(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in expected}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(table, none).count() == 0 and decontaminate.find(frame(spark, []), bench).count() == 0


def test_decontamination_judges_each_row_by_its_text(spark):
    item = prose(950, 30)
    rows = [(None, prose(951, 40) + " " + item), (None, prose(952, 60)), (None, None), (None, ""), (5, item), (5, prose(953, 60)), (5, None), (6, prose(954, 60)), (6, prose(954, 60))]
    bench = spark.createDataFrame([(1, item), (2, prose(955, 25))], "item_id long, text string")
    for at_once in (decontaminate.BROADCAST_BYTES, 5000):
        left = decontaminate.remove(frame(spark, rows), bench, broadcast_bytes=at_once)
        assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(rows[1:4] + rows[5:])
    assert {r.doc_id for r in decontaminate.find(frame(spark, rows), bench).collect()} == {None, 5}


def test_decontamination_looks_between_placements(spark):
    item = [f"i{k}" for k in range(104)]
    copy = ["a", "b", "c", *item[3:52], *[f"new{k}" for k in range(10)], *item[52:101], "x", "y", "z"]
    docs = frame(spark, [(1, prose(960, 30) + " " + " ".join(copy) + " " + prose(961, 30)), (2, prose(962, 200))])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontaminate.find(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)] and found[0].similarity > 0.75
    extra = docs.withColumns({"__row": docs.rep, "__id": docs.rep, "__hash": docs.key, "id": docs.rep, "m": docs.key, "starts": docs.key})
    assert [r.doc_id for r in decontaminate.remove(extra, bench).collect()] == [2]
