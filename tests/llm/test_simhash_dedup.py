import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from nearwave.llm.components import components
from nearwave.llm.simhash_dedup import BLOCKS, fingerprint, keep_one_per_group, near_duplicates, near_links, spanning_links
from tests.llm.odd_texts import ODD_TEXTS


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{position: positions linked to it, through others too}."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            changed = list(base)
            changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(" ".join(changed).upper() if rng.random() < 0.3 else "  ".join(changed))
    return texts


def test_any_three_bytes_leave_a_block_free():
    from itertools import combinations

    assert len(BLOCKS) == 14
    for wrong in combinations(range(8), 3):
        assert any(not set(wrong) & set(block) for block in BLOCKS)


def test_fingerprint_is_the_contract():
    for text in [t or "" for t in ODD_TEXTS if len(t or "") < 1000] + near_texts():
        assert fingerprint(text) == plain_fingerprint(text)


def test_components_against_brute_force(docs_of):
    texts = near_texts() + [t for t in ODD_TEXTS if len(t or "") < 1000]
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps)
    got = {r.doc_id: r for r in near_duplicates(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for i, fp in enumerate(fps):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == want[i]


def test_chunked_lists_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp BIGINT")
    want = plain_components(fps)
    found = {r.node: r.component for r in components(near_links(distinct, chunk=16)).collect()}
    groups = {}
    for f, g in zip(signed, want):
        groups.setdefault(g, set()).add(f)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_spanning_links_are_few():
    values = np.array([1, 2, 3, 4, 5, 6, 7], np.int64)
    assert len(spanning_links(values)) == 6


def test_one_row_of_each_group_stays(spark, docs_of):
    texts = [(5, "a b c d"), (5, "a b c d"), (2, "A b c d"), (None, "a b c d"), (9, "x y z"), (None, "q r s"), (None, "q r s")]
    rows = keep_one_per_group(docs_of(texts)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in rows) == [(-1, "q r s"), (2, "A b c d"), (9, "x y z")]
    assert keep_one_per_group(docs_of(texts).limit(0)).count() == 0
    extra = docs_of(["a", "b"]).selectExpr("*", "1 AS fp", "2 AS component", "3 AS `first`", "4 AS component_id")
    assert {tuple(r)[-4:] for r in keep_one_per_group(extra).collect()} == {(1, 2, 3, 4)}


def test_empty_table_and_ids(docs_of):
    assert near_duplicates(docs_of(["a"]).limit(0)).count() == 0
    rows = near_duplicates(docs_of([(None, "a b c"), (None, "q r s t"), (7, "a b c")])).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in rows) == [(False, False), (True, False), (True, True)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a BIGINT, b BIGINT")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_clashing_names(docs_of):
    docs = docs_of(["some text of a few words", "some text of a few words", "quite another text, of other words"])
    for name in ("row_hash", "_row_hash", "kept_id", "_kept_id", "_kept_hash", "fp", "hash", "component"):
        rows = keep_one_per_group(docs.withColumn(name, F.lit("mine"))).collect()
        assert sorted(r.doc_id for r in rows) == [0, 2] and all(r[name] == "mine" for r in rows)
