"""Cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trolley.llm import token_align as TA

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "Hello world, it's  two   spaces ", "né 字字😀 <|endoftext|> </s> <unk> <0x41>", "line\n\n next\t tab \x00 x", "▁ mark",
         "w " * 3000, "unspaced" * 500, "Hello world, it's  two   spaces ", "\r\n 　 \xa0 é", "\x1c a \x1d", "1234567890 $$ ##"]


def plain(texts):
    """Tokens by the libraries, ends by loops, overlaps by comparing every two tokens near each other."""
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    letters = TA.byte_alphabet()
    out, held = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        spans = []
        for pieces in ([bytes(letters[c] for c in t.id_to_token(i)) for i in a],
                       [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]):
            if b"".join(pieces) != (" " + text).encode():
                spans = None
                break
            at, mine = 0, []
            for p in pieces:
                mine.append((at, at + len(p)))
                at += len(p)
            spans.append(mine)
        if spans is None:
            out.append(None)
            continue
        links, j0 = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        ia = ib = 0
        for cut in cuts:
            ga, gb = [], []
            while ia < len(a) and spans[0][ia][1] <= cut:
                ga.append(str(a[ia]))
                ia += 1
            while ib < len(b) and spans[1][ib][1] <= cut:
                gb.append(str(b[ib]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        out.append((len(a), len(b), len(cuts), Counter(links), ";".join(groups)))
        held.update(set(links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for r in out:
        if r is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, g, links, text = r
            rows.append((n_a, n_b, g, links.total(), sum(n for p, n in links.items() if held[p] == best[p[0]]),
                         sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return rows


def result(spark, docs, **options):
    from trolley.llm.common import stage
    from pyspark.sql import functions as F
    found = stage(TA.align(docs, A, B, **options).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    return found.join(TA.score_links(found, "rid"), "rid", "left").fillna(0, ["n_best", "count_sum"]).collect()


@pytest.mark.parametrize("piece", [1, 7, 65_536])
def test_overlaps_of_random_sequences(piece):
    rng = np.random.default_rng(piece)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        a, b = (np.append(np.flatnonzero(rng.random(n) < rng.random()) + 1, n + 1) for _ in range(2))
        end, i, j, shared = TA.overlaps(a, b, piece)
        starts = [np.append(0, x[:-1]) for x in (a, b)]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts[0][x], starts[1][y]) < min(a[x], b[y])]
        assert list(zip(i.tolist(), j.tolist())) == want and set(end[shared]) == set(a) & set(b)
        cuts = TA.merge_path(a, b, piece)
        assert (np.diff(cuts[0] + cuts[1])[:-1] == piece).all()


def test_chunks_are_not_another_encoding():
    rng = random.Random(4)
    enc = TA.Encoder(open(A, "rb").read(), open(B, "rb").read())
    assert enc.cuts
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    signs = ["a", "the", "'s", " ", "  ", "\n", "\t", "\x1c", "\xa0", "　", "1", "99", "!", "..", "é", "字", "😀", "▁", "<|endoftext|>", "<s>", "\r\n", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(400)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        if ids is not None:
            got = [np.frombuffer(x, np.int32).tolist() for x in ids]
            assert got == [t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)], text
        else:
            assert "▁" in text


@pytest.mark.parametrize("piece", [3, 65_536])
def test_alignment_is_that_of_plain_loops(spark, piece):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, N_A string").repartition(3)
    got = {r["doc_id"]: r for r in result(spark, docs, piece=piece)}
    for k, want in enumerate(plain(TEXTS)):
        r = got[k]
        digest = hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else ""
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], digest) == want, TEXTS[k]
    assert TA.align(docs.limit(0), A, B).count() == 0


def test_op12(spark):
    got = TA.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, plain([texts[i] for i in ids])))
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got} == want
