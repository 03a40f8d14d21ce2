import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from shopledger.llm import alignment
from shopledger.llm.queries import op11_tokenizer_alignment
from shopledger.llm.tokenizers import ByteTokens, PieceTokens, Tokenizer

from .conftest import LONG

ODD = [
    None, "", " ", "one two three", "one two three", "x▁y", "<|endoftext|> <s> <0x0A>", "中文 😀 naïve", "a" * 300,
    "　\x00\x85  ", "  two  spaces ", "Ａ　ﬁ", LONG[:20_000],
]


def rising(most):
    return st.sets(st.integers(1, most), min_size=1).map(sorted)


@settings(deadline=None, max_examples=300)
@given(rising(60), rising(60))
def test_cuts_are_the_shared_ends(a, b):
    end = max(a[-1], b[-1]) + 1
    a, b = np.array([*a, end]), np.array([*b, end])
    found = alignment.shared_cuts(a, b, np.array([len(a) - 1]))
    assert found.tolist() == [i for i, x in enumerate(a.tolist()) if x in set(b.tolist())]


@pytest.mark.parametrize("gap", [1, 7, 1000])
def test_cuts_beside_long_stretches_without_any(gap):
    rng = random.Random(gap)
    ends, a, b = 0, [], []
    for _ in range(200):
        for _ in range(rng.randint(0, gap)):
            ends += 2
            rng.choice([a, b]).append(ends)
        ends += 1
        a.append(ends)
        b.append(ends)
    found = alignment.shared_cuts(np.array(a), np.array(b), np.array([len(a) - 1]))
    assert np.array(a)[found].tolist() == sorted(set(a) & set(b))


@pytest.fixture(scope="module")
def sides(spark):
    one = Tokenizer(spark, ByteTokens, P.path("byte_bpe_50k.json"), P.PATTERN)
    return one, Tokenizer(spark, PieceTokens, P.path("piece_bpe_32k.model"))


def plainly(texts):
    """The contract of the query word by word, with the two libraries."""
    library = Library.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    spelled = ByteTokens(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN).spelled
    out, corpus = [], Counter()
    for text in texts:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(spelled[i] for i in a) != want or b"".join(bytes_b) != want:
            out.append(([], [], [], []))
            continue
        spans = []
        for sizes in ([len(spelled[i]) for i in a], [len(x) for x in bytes_b]):
            ends = np.cumsum(sizes).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links, at = [], 0
        for i, (low, high) in enumerate(spans[0]):
            while spans[1][at][1] <= low:
                at += 1
            j = at
            while j < len(b) and spans[1][j][0] < high:
                links.append((a[i], b[j]))
                j += 1
        corpus.update(links)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in shared:
            groups.append([[x for x, (s, e) in zip(ids, span, strict=True) if low <= s and e <= cut] for ids, span in zip((a, b), spans, strict=True)] if len(a) < 3000 else None)
            low = cut
        out.append((a, b, groups, links))
    top = defaultdict(int)
    for (_, y), n in corpus.items():
        top[y] = max(top[y], n)
    rows = []
    for a, b, groups, links in out:
        listed = None if None in groups else ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        rows.append((len(a), len(b), len(groups), listed, len(links), sum(corpus[x] == top[x[1]] for x in links), sum(corpus[x] for x in links)))
    return rows


def same(found, want):
    """Groups of very long texts are not spelled out by the plain version."""
    return len(found) == len(want) and all(f[:3] + f[4:] == w[:3] + w[4:] and w[3] in (None, f[3]) for f, w in zip(found, want, strict=True))


def test_against_the_definition(docs, sides, monkeypatch):
    rng = random.Random(3)
    words = ["the", "Weather", "naïve", "ünder", "12,345", "....", "\n\n", "\t", "don't", "中文", "😀", "ßß", "<s>", "aaaaaaa"]
    texts = ODD + [" ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    table = docs([*enumerate(texts)]).withColumnRenamed("lang", "n_a").withColumnRenamed("source", "__chunk")
    want = plainly(texts)
    for size in (alignment.CHUNK_BYTES, 300):
        monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
        found = [tuple(r)[1:] for r in sorted(alignment.aligned(table, *sides).collect(), key=lambda r: r["doc_id"])]
        assert same(found, want)


def test_repeated_and_missing_keys(docs, sides):
    rows = alignment.aligned(docs([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)]), *sides).collect()
    assert sorted((r["doc_id"] is None, r["n_a"], r["n_links"], r["count_sum"]) for r in rows) == [(False, 2, 2, 6), (False, 2, 2, 6), (True, 0, 0, 0), (True, 2, 2, 6)]


def test_text_keys(spark, sides):
    rows = alignment.aligned(spark.createDataFrame([("k", "one")], "doc_id string, text string"), *sides).collect()
    assert [(r["doc_id"], r["groups"]) for r in rows] == [("k", "530|624")]


def test_empty_table(docs, sides):
    assert alignment.aligned(docs([]), *sides).count() == 0


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = dict(zip(texts, plainly(texts.values()), strict=True))
    rows = op11_tokenizer_alignment(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_a, n_b, n_groups, listed, n_links, n_best, count_sum = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        if listed is not None:
            assert r["groups_sha256"] == (hashlib.sha256(listed.encode()).hexdigest() if n_a else "")


def test_byte_tokens_are_those_of_the_library():
    library = Library.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    model = ByteTokens(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN)
    rng, known = random.Random(1), [x.decode() for x in model.spelled if x.decode(errors="ignore").encode() == x]
    texts = ["".join(rng.choice(known) for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x10FFFF), 0x85, 0xA0, 0x2028, 32])) for _ in range(8)) for _ in range(10_000)]
    assert model.encode(texts) == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        ByteTokens(open(P.path("word_bpe_49k.json"), "rb").read(), P.PATTERN)
