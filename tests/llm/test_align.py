import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from tablediff.llm import align as L
from tablediff.llm.token_count import byte_chars

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, pairs int"
LONG = " ".join(f"zorb{i % 91} Überé-{i % 17}, o'clock's\n\n x{i}" for i in range(1500))
TEXTS = ["", "a ", " a", "  ", "x  y ", "\n b", "▁ q", "a▁b", "a　 b\tc d", "<|endoftext|> hi <s> it's </s> <0x0A>", "日本 語 テキスト\x00", "é " * 60, "\x1c x \x85 y\xa0 z", "🙂🙃👍🏽 ok", "0123456789" * 30, "x" * 3000, "don't  stop\r\n now", LONG]


def brute(docs):
    """Whole texts through both libraries; groups by the offsets at which both end, links by every pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, back = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH), byte_chars()
    a.encode_special_tokens = True
    rows, held = [], Counter()
    for doc_id, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            rows.append((doc_id, 0, 0, 0, {}, ""))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest()
        rows.append((doc_id, len(ids_a), len(ids_b), len(groups), links, digest))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, n_a, n_b, n, links, digest in rows:
        best = sum(k for p, k in links.items() if held[p] == most[p[0]])
        out.append((doc_id, n_a, n_b, n, sum(links.values()), best, sum(k * held[p] for p, k in links.items()), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [(L.PAIRS, L.PIECE, L.UNITS), (0, 40, 3)])
def test_equals_brute_force(spark, limits, monkeypatch):
    most, piece, units = limits
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (900, None), (1, "a "), (1, "a ")]
    docs += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "UNITS", units)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(3)
    got = L.link(df, A_PATH, B_PATH, most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)


def test_pieces_of_a_long_text_are_joined(monkeypatch):
    both = L.Aligner(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    assert both.by_unit
    whole = both.align([LONG, "x", LONG])
    monkeypatch.setattr(L, "PIECE", 50)
    both._forget()
    cut = both.align([LONG, "x", LONG])
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut))


def test_components_are_those_of_the_overlap_graph():
    rng = np.random.default_rng(5)
    for _ in range(200):
        end = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, 30)), end)) for _ in range(2))
        cut = np.intersect1d(a, b)
        in_a, in_b = L.components(a, b)
        assert in_a.tolist() == np.searchsorted(cut, a).tolist() and in_b.tolist() == np.searchsorted(cut, b).tolist()


def test_connected_over_any_graph():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n, e = int(rng.integers(1, 60)), int(rng.integers(0, 80))
        u, v = rng.integers(0, n, e), rng.integers(0, n, e)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(u, v):
                label[x] = label[y] = min(label[x], label[y])
        assert L.connected(n, u, v).tolist() == label


def test_empty_table(spark):
    assert L.link(spark.createDataFrame([], SCHEMA), A_PATH, B_PATH).collect() == []
