import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from shopledger.llm import personal
from .test_learned import plain_spans
from .test_packing import check_places
from .test_simhash import plain, smallest
from .test_substrings import brute


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "passages", "personal_data", "packing"]
    assert {"pipeline", *(f"op{i}" for i in range(1, 14))} <= {k.split("_")[0] for k in entry.queries()}


def test_every_stage_on_the_rows_of_the_one_before(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = stage("language")(spark, docs, small)
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == columns and after.items() <= before.items() and len(after) >= 0.99 * len(before)

    docs, before = kept, after
    kept = stage("near_copies")(spark, docs, small)
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    roots = smallest({i: plain(t) for i, t in before.items()})
    assert kept.columns == columns and after == {i: t for i, t in before.items() if roots[i] == i}

    docs, before = kept, after
    kept = stage("passages")(spark, docs, small)
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {k: (m, t) for k, _, m, t in brute(list(before.items()))}
    assert kept.columns == columns and after == {k: t if m else before[k] for k, (m, t) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    docs, before = kept, after
    kept = stage("personal_data")(spark, docs, small)
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == columns and after.keys() == before.keys()
    for k, text in before.items():
        spans = plain_spans(text)
        assert not plain_spans(after[k]) and (spans or "[" in after[k] or after[k] == text)
        for kind, a, b in spans:
            assert f"[{kind.upper()}]" in after[k] or any(x < b and a < y and (x, y) != (a, b) for _, x, y in spans)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stage("packing")(spark, kept, small).collect()
    check_places(rows, 2048)
    sizes = {}
    for r in rows:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in after.items()}


def test_documents_without_letters_go(spark, docs, small):
    rows = docs([(1, "the cat and the dog", "en"), (2, None, "en"), (3, "", "en"), (4, "123 !!", "en"), (5, "der Hund und die Katze", "de")])
    assert sorted(r["doc_id"] for r in stage("language")(spark, rows, small).collect()) == [1, 5]


def test_empty_documents_pass_all_stages(spark, docs, small):
    rows = docs([])
    for _, step in pipeline.STAGES:
        rows = step(spark, rows, small)
        assert rows.count() == 0


def test_odd_rows_pass_all_stages(spark, docs, odd, small):
    """Very long, null and empty texts, a row without an id, a repeated one, and columns of other types."""
    learned = docs([(100, "the cat and the dog are here", "en"), (101, "der Hund und die Katze sind hier", "de")])
    rows = odd.unionAll(learned).selectExpr("*", "map('k', doc_id) __language", "array(struct(text)) personal", "0 __slice")
    columns = rows.columns
    for name, step in pipeline.STAGES:
        before, rows = rows, step(spark, rows, small)
        if name != "packing":
            assert rows.columns == columns
            lengths = {r["doc_id"]: len(r["text"] or "") for r in rows.collect()}
            assert 0 < len(lengths) <= before.count()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in rows.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect()}


def test_ambiguous_texts_stay_whatever_their_length(spark, docs, small):
    mixed = "the cat and der Hund "
    rows = docs([(1, "the cat and the dog are here", "en"), (2, "der Hund und die Katze sind hier", "de"), (3, mixed, None), (4, mixed * 50, None)])
    assert stage("language")(spark, rows, small).count() == 4


def test_run(spark, small):
    rows = pipeline.run(spark, small).collect()
    assert rows and check_places(rows, 2048) > 0


def test_redaction_uses_the_spans_of_the_operator():
    model = personal.SpanModel()
    spans = [(a, b, k) for k, a, b, _ in personal.all_spans(model, "to a@b.co now")]
    assert personal.masked("to a@b.co now", spans) == "to [EMAIL] now"
