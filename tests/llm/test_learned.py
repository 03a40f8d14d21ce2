"""Language, quality and personal data: learned models on held-out rows, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from shopledger.llm import language, personal, quality
from shopledger.llm.queries import op5_quality_scores, op6_language_id, op7_personal_data

MEDIUM = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns_on_random_texts():
    rng = random.Random(9)
    parts = ["1", "23", "456", "255", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "@x.y", "4539578763621486", " ", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert personal.base_spans(text) == plain_spans(text), text


@pytest.fixture(scope="module")
def span_model():
    rng, sample = random.Random(1), []
    for _ in range(150):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        sample += [f"word +1 ({a}) {b}-{c}", f"name.{a}@mail{b % 9}.example.com", f"word {a % 256}.{b % 256}.{c % 256}.7", f"v {a % 10}.0.", f"4539578763621486 x{a}"]
    return personal.learn(sample)


def test_model_adds_other_notations_and_leaves_look_alikes(span_model):
    def added(text):
        return [(k, text[a:b]) for k, a, b in span_model.spans(text, personal.base_spans(text))]

    assert added("call (988) 555-2485 now") == [("phone", "(988) 555-2485")]
    # The pattern takes a phone and a card that follow each other for one long number and drops it.
    assert ("phone", "+1 (269) 555-3296") in added("x +1 (269) 555-3296 4524132264652876 y")
    for text in ("on 2024-01-15 at 10:30:15", "license 4.0, part 2.1", "1,234,567 in total", "plain words only"):
        assert added(text) == []


def best_split(n, found, scores):
    """Brute force over all sets of segments that do not overlap."""
    best = (0.0, [])

    def walk(at, value, chosen):
        nonlocal best
        if value > best[0]:
            best = (value, chosen)
        for s, x in zip(found, scores, strict=True):
            if s.first >= at:
                walk(s.last, value + x, [*chosen, s])

    walk(0, 0.0, [])
    return best


def test_dynamic_programming_equals_all_splits():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 7)
        found = [personal.Segment(a, rng.randint(a + 1, n), "ip", [str(i)]) for i, a in enumerate(rng.choices(range(n), k=6))]
        model = personal.SpanModel({str(i): rng.uniform(-2, 2) for i in range(6)})
        scores = model._scores(found)
        chosen = model.best(n, found)
        assert abs(sum(model._scores(chosen)) - best_split(n, found, scores)[0]) < 1e-9
        expected = model.expected(n, found)
        assert all(0 <= p <= 1 + 1e-9 for p in expected)


def test_masking():
    assert personal.masked("a b c", [(2, 3, "ip"), (0, 1, "email")]) == "[EMAIL] [IP] c"
    assert personal.masked("abcdef", [(0, 4, "card"), (2, 5, "phone")]) == "[CARD]f"


def test_personal_odd_rows(odd, span_model):
    rows = personal.with_personal_data(odd.withColumnRenamed("lang", "personal"), span_model).collect()
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["personal"] if s["base"]] == plain_spans(r["text"])
    assert odd.select(personal.redacted(span_model, odd["text"]).alias("t")).where("t is null").count() == 1


def test_personal_without_anything_to_learn_from(docs):
    model = personal.fit(docs([(1, "nothing here"), (2, None)]))
    assert model.weights == {} and personal.with_personal_data(docs([]), model).count() == 0


def test_rare_kinds_are_learned_wherever_they_are(docs, monkeypatch):
    """The one mail address is the 71st island of one of 3,000 documents full of numbers."""
    monkeypatch.setattr(personal, "FIT_ISLANDS", 20)
    rows = [(i, f"part {i} and 20{i % 90 + 10}-01-02 or {i}.5") for i in range(3000)]
    rows.append((5000, ", then ".join(f"{n},{n} units" for n in range(70)) + " then jo.doe@mail.example.org"))
    taken = personal.sampled_islands(docs(rows)).collect()
    assert [r["island"].endswith("jo.doe@mail.example.org") for r in taken if r["kind"] == "email"] == [True]
    assert sum(r["kind"] == "none" for r in taken) == 20
    every = {r["island"]: r["h"] for r in personal.sampled_islands(docs(rows[:300])).collect() if r["kind"] == "none"}
    monkeypatch.setattr(personal, "FIT_ISLANDS", 10**6)
    full = sorted((r["h"], r["island"]) for r in personal.sampled_islands(docs(rows[:300])).collect() if r["kind"] == "none")
    assert sorted((h, i) for i, h in every.items()) == full[:20]


def test_personal_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    for r in op7_personal_data(spark, MEDIUM).collect():
        base = plain_spans(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9):
        code = language.codewords(n)
        least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert code.shape[0] == n and least >= max(1, code.shape[1] // 4)
        assert all(len(set(code[:, b])) == 2 for b in range(code.shape[1]))


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    held = [r for r in op6_language_id(spark, MEDIUM).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_odd_rows(docs, odd):
    learned = [(i, "the cat and the dog are here" if i % 2 else "der Hund und die Katze sind hier", "en" if i % 2 else "de") for i in range(10)]
    model = language.fit(docs([*learned, (99, None, "xx"), (98, "no language")]))
    rows = {r["doc_id"]: r for r in language.with_language(odd.withColumnRenamed("lang", "score"), model).collect()}
    assert model.languages == ["de", "en"] and len(rows) == len({r["doc_id"] for r in odd.collect()})
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 6, 9))
    assert rows[4]["lang_pred"] in ("de", "en")
    for few in ([], [(1, "one language only", "en")]):
        model = language.fit(docs(few))
        pred = language.with_language(docs([(1, "some text"), (2, None)]), model).collect()
        assert {r["doc_id"]: r["lang_pred"] for r in pred} == {1: "en" if few else "und", 2: "und"}
    assert language.with_language(docs([]), model).count() == 0


def test_languages_against_a_plain_computation(docs):
    """Slot counts, odds, margins and losses written out."""
    texts = {"en": "The cat and the dogs were here, with us. Thé café", "de": "Der Hund und die Kätzchen sind jetzt hier", "fr": "Le chat est là où le chien dort"}
    model = language.fit(docs([(i, f"{t} {i}", x) for i, (x, t) in enumerate([*texts.items()] * 4)]))

    def slots(text):
        kept = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
        raw, found = (" " + " ".join(kept.split()) + " ").encode(), {}
        for size in (2, 3):
            for i in range(len(raw) - size + 1):
                code = size
                for byte in raw[i : i + size]:
                    code = (code * 257 + byte) % 2**32
                slot = (code * 2654435761 % 2**32) >> 19
                found[slot] = found.get(slot, 0) + 1
        return found

    names = sorted(texts)
    counts = {x: {} for x in names}
    for i, (x, t) in enumerate([*texts.items()] * 4):
        for k, n in slots(f"{t} {i}").items():
            counts[x][k] = counts[x].get(k, 0) + n
    share = {x: [(counts[x].get(k, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * 8192) for k in range(8192)] for x in names}
    code = language.codewords(3)
    for text in ("the dog sat", "und der Hund", "où est le café", "jetzt cat"):
        own, losses = slots(text), [0.0] * 3
        for b in range(code.shape[1]):
            plus, minus = ([x for x, row in zip(names, code, strict=True) if row[b] == s] for s in (1, -1))
            odds = [np.log(sum(share[x][k] for x in plus) / len(plus)) - np.log(sum(share[x][k] for x in minus) / len(minus)) for k in range(8192)]
            typical = [code[i][b] * sum(p * o for p, o in zip(share[x], odds, strict=True)) for i, x in enumerate(names)]
            scale = sum(abs(v) for v in typical) / 3
            weight = max(0.05, min(typical) / scale)
            margin = sum(n * odds[k] for k, n in own.items()) / sum(own.values()) / scale
            for i in range(3):
                losses[i] += weight * np.exp(-code[i][b] * margin)
        assert np.allclose(model.losses(text), losses)
        assert model.predict(text)[0] == names[int(np.argmin(losses))]


def test_number_signs_are_no_letters(docs):
    model = language.fit(docs([(1, "the cat", "en"), (2, "der Hund", "de")]))
    assert {model.predict(t)[0] for t in ("½", "²³", "①", "Ⅳ", "٣", "_")} == {"und"}
    assert {model.predict(t)[0] for t in ("ª", "ʰ", "中")} & {"und"} == set()


def test_mixed_text_is_flagged(docs):
    learned = [(i, t, x) for i in range(10) for t, x in (("the cat and the dog were here with us", "en"), ("der Hund und die Katze sind jetzt hier", "de"))]
    model = language.fit(docs(learned))
    assert not model.predict("the dog and the cat")[2]
    scores = [model.predict(t)[1] for t in ("the dog and the cat", "the dog and der Hund und")]
    assert scores[0] > scores[1]


def test_quality_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in op5_quality_scores(spark, MEDIUM).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (6, 0), (None, 1), (77, None)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    rows = quality.with_quality(odd.withColumnRenamed("lang", "predicted"), model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.fit(docs([]), labels)
    assert {r["score"] for r in quality.with_quality(odd, none).collect()} == {0.5}
    assert quality.with_quality(docs([]), none).count() == 0


def test_a_repeated_key_does_not_widen_the_sample(spark, docs, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "learn", lambda x, y: sizes.append(len(y)))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    quality.fit(docs([(1, f"text {i % 90}") for i in range(200)] + [(2, "x")]), labels, rows=1)
    quality.fit(docs([(1, "same text")] * 50 + [(2, "x")]), labels)
    quality.fit(docs([(1, f"text {i}") for i in range(200)] + [(2, "x")]), labels, rows=20)
    assert sizes == [1, 2, 20]


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = (x[:, 2] * x[:, 5] > 0).astype(float)  # no single feature tells
    model = quality.learn(x, y)
    assert (2, 5) in {(a, b) for a, b, *_ in model.pairs}
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (400, len(quality.FEATURES)))
    model = quality.learn(x, (x[:, 0] > 0.5).astype(float))
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.base + sum(t[(c <= v).sum()] for v, c, t in zip(row, model.cuts, model.tables, strict=True))
        total += sum(t[(ca <= row[a]).sum(), (cb <= row[b]).sum()] for a, b, ca, cb, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
