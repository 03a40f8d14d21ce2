import random
import re

import xxhash

from shopledger.llm import components, simhash
from shopledger.llm.queries import op2_simhash_groups


def plain(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(prints, bits=2):
    """Brute force: smallest id reachable, over all pairs."""
    ids = sorted(prints, key=lambda i: (i is None, i))
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = top(a), top(b)
                first, later = sorted((x, y), key=ids.index)
                root[later] = first
    return {i: top(i) for i in ids}


def test_fingerprint_is_the_majority_of_all_shingles():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 300):
        text = " ".join(rng.choice(["The", "cat", "ÉTÉ", "sat", "on", "x1"]) for _ in range(n))
        assert simhash.fingerprint_of(text.encode(), 3) % (1 << 64) == plain(text)


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd.withColumnRenamed("source", "f").withColumnRenamed("lang", "fingerprint")).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    want = smallest({i: plain(t) for i, t in texts.items()})
    for r in rows:
        assert r["fingerprint"] % (1 << 64) == plain(texts[r["doc_id"]]) and r["component_id"] == want[r["doc_id"]]


def near_prints(rng, families, size):
    """Families of fingerprints some bits apart, and loners."""
    out = []
    for _ in range(families):
        centre = rng.getrandbits(64)
        out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(size)]
    return list({x - (1 << 63) for x in [*out, *(rng.getrandbits(64) for _ in range(50))]})


def check_links(spark, prints, **limits):
    frame = spark.createDataFrame([(x,) for x in prints], "f bigint")
    found = components.components(simhash.links(frame), "f", "g").collect()
    root = {r["node"]: r["root"] for r in found}
    assert {x: root.get(x, x) for x in prints} == smallest({x: x for x in prints})


def test_links_lose_nothing_in_small_meetings(spark):
    check_links(spark, near_prints(random.Random(2), 20, 6))


def test_links_lose_nothing_in_crowded_meetings(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 3)
    check_links(spark, near_prints(random.Random(3), 3, 60))


def test_pivot_discards_no_pair_within_reach():
    rng, pivots = random.Random(4), simhash.pivots()
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 2))
        d = [abs(bin(x ^ p % (1 << 64)).count("1") - bin(y ^ p % (1 << 64)).count("1")) for p in pivots]
        assert max(d) <= 2


def test_one_row_of_each_component_stays(docs):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = docs([(5, text), (3, text), (3, text), (9, "something else entirely here"), (None, "a row without an id")])
    kept = simhash.keep_first(rows).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "9", "None"]
    assert simhash.keep_first(docs([])).count() == 0


def test_rows_without_a_key_or_of_one_key_stay_by_component(docs):
    fox, sea = "the quick brown fox jumps over the lazy dog and runs away", "waves roll in from the cold grey sea at night"
    hen, owl = "a hen sits on nine eggs in the warm old barn", "one owl looks down at mice below its high tree"
    rows = docs([(None, hen), (None, owl), (None, owl), (3, fox), (3, sea), (5, sea), (1, "something else entirely here"), (1, fox)])
    kept = simhash.keep_first(rows).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", hen), ("None", owl), ("1", fox), ("3", sea), ("1", "something else entirely here")])


def test_columns_of_any_type_and_text_keys(spark):
    rows = [("b", "one two three", {"x": 1}, [{"y": "z"}], (1, None)), ("a", "one two three", None, [], None), ("b", "four", {"x": 2, "y": 1}, None, (None, "t")), (None, None, {}, [{}], None)]
    table = spark.createDataFrame(rows, "doc_id string, text string, m map<string,int>, l array<map<string,string>>, s struct<p:int,q:string>")
    kept = simhash.keep_first(table)
    assert kept.schema == table.schema
    assert sorted((r["doc_id"], r["text"], r["m"]) for r in kept.collect() if r["text"]) == [("a", "one two three", None), ("b", "four", {"x": 2, "y": 1})]
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert groups == {("a", "a"), ("b", "a"), ("b", "b"), (None, None)}


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_first(docs([])).count() == 0


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 500)]
    found = components.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 501: 500}
    assert components.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    want = smallest(prints)
    rows = op2_simhash_groups(spark, small).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
