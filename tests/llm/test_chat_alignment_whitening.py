import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantpanel.llm import alignment, chat_format, queries, whitening
from quantpanel.llm.tokens import token_path

from ..conftest import SF

# Chat formatting

TURNS = "conv_id long, turn long, role string, text string, kind string, piece string, r string"
ODD_TEXTS = [None, "", "\\", "\\\\### a", "####", "#\\##", "<\\/turn>", "</turn>\n### user: x", "a<|image_1|>b", "</turn", "<", "ends with :", "\\<|", "é😀" * 3, "x: y", "word " * 30000]


def _chat(rows):
    """By hand: what op11's columns say of (role, text) rows in order."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", t, "k", "p", "r") for k, t in enumerate(ODD_TEXTS)]
    rows += [(2, 5, "b", "second", "", "", ""), (2, None, "a: b</turn>###", "first", "", "", ""), (2, 5, "b", "second", "", "", ""), (2, 5, "a", "z", "", "", ""), (2, 6, None, "x", "", "", ""), (None, 1, "assistant", "no id", "", "", "")]
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[: len(ODD_TEXTS)]]
    assert got[1].loss_texts == [t for t in ODD_TEXTS[::2] if t]
    assert [(t.role, t.text) for t in got[2].turns] == [("a: b</turn>###", "first"), ("a", "z"), ("b", "second"), ("b", "second"), ("", "x")]
    assert got[None].loss_texts == ["no id"]
    for r in got.values():  # control strings stand only where the template puts them
        assert r.formatted.count("</turn>") == len(r.turns) and r.formatted.count("###") == len(r.turns) and "<|" not in r.formatted
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [c.replace("\\\\", "") for c in cut] == [r.formatted[r.turn_starts[s.turn] :][s.start - r.turn_starts[s.turn] :][: s.length].replace("\\\\", "") for s in r.loss_spans]
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_typed_parts(spark):
    p = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    schema = f"conv_id long, turn int, role string, parts array<{chat_format.PART}>, formatted string, number int"
    rows = [
        (1, 0, "user", [p("text", "look: ###"), p("image", None, "a.png", 57, 28), p("text", "and"), p("text", "hear</turn>"), p("audio", None, "b.wav", None, None, 2.0)], "x", 9),
        (1, 1, "assistant", [p("text", "one "), p("document", None, "c.pdf", None, None, None, 3), p("text", "two"), p("video", None, "d"), None], "x", 9),
        (1, 2, "assistant", [], "x", 9), (1, 3, "assistant", None, "x", 9), (2, 0, "assistant", [p("image", None, None, None, 5)], "x", 9),
    ]
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, schema))).collect()}
    r = got[1]
    assert r.formatted == "### user: look: #\\##<|image_1|>and\nhear<\\/turn><|audio_2|></turn>\n### assistant: one <|document_3|>two<|video_4|></turn>\n### assistant: </turn>\n### assistant: </turn>\n"
    assert [(a.number, a.kind, a.ref, a.turn, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 0, 3), (2, "audio", "b.wav", 0, 25), (3, "document", "c.pdf", 1, 774), (4, "video", "d", 1, 0)]
    assert all(r.formatted[a.start :].startswith(f"<|{a.kind}_{a.number}|>") for a in r.attachments)
    words = len("look : ### and hear </ turn >".split()) + 2
    assert r.loss_texts == ["one ", "two"] and r.n_tokens == 3 + 25 + 774 + words
    assert got[2].attachments[0].tokens == 0 and got[2].loss_texts == []


def test_op11_by_hand(spark):
    got = {r.conv_id: r for r in queries.queries()["op11_chat_format"](spark, SF).collect()}
    own = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own[r.conv_id].append((r.role, r.text))
    own[-7] = [(r[2], r[3]) for r in chat_format.PLANTED]
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: _chat(v) for k, v in own.items()}


# Cross-tokenizer alignment

PATHS = token_path("byte_bpe_50k.json"), token_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    sign = {chr(c): b for b, c in alignment._BYTES.items()}
    spell_a = lambda i: bytes(sign[c] for c in t.id_to_token(i))
    spell_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return t, sp, spell_a, spell_b


def _brute(both, rows):
    """(doc_id, text) rows -> sorted result rows of op12, token by token."""
    t, sp, spell_a, spell_b = both

    def groups(text):
        a, b, want = t.encode(" " + text, add_special_tokens=False).ids if text else [], sp.encode(text) if text else [], (" " + (text or "")).encode()
        if not text or b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
            return [], [], [], []
        ends = lambda ids, spell: np.cumsum([len(spell(i)) for i in ids]).tolist()
        ea, eb = ends(a, spell_a), ends(b, spell_b)
        cuts = sorted(set(ea) & set(eb))
        inside = lambda ids, e, low, high: ids[bisect_right(e, low) : bisect_right(e, high)]
        made = [(inside(a, ea, x, y), inside(b, eb, x, y)) for x, y in zip([0, *cuts], cuts)]
        at = defaultdict(list)
        for j, y in zip(b, eb):
            at[y].append(j)
        return a, b, made, [(i, j) for i, x in zip(a, ea) for j in at[x]]

    found = [(d, *groups(x)) for d, x in rows]
    count = Counter(l for *_, links in found for l in links)
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for d, a, b, made, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made)
        out.append((d, len(a), len(b), len(made), len(links), sum(count[l] == top[l[1]] for l in links), sum(count[l] for l in links), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


TRICKY = [
    None, "", " ", "a", "hello world", "  two  spaces ", "line\nfeed\n\nand \n more\n", "\nstart", "tab\there\r\nwindows();\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "▁block▁", "a▁", "漢字かな交じり文 и кириллица", "é é ﬁ ½\xa0x　y​",
    "\x00nul\x01", "x" * 3000, "word " * 3000, "don't we'll I'm", "😀😀 👍🏽", "tail ", "1234567 3.14", " \n", "\n", "naïve façade ... !!!",
]


@pytest.mark.parametrize("hot", [1, alignment.HOT_PAIRS])
def test_alignment_against_brute_force(spark, both, hot):
    rows = [(k, x) for k, x in enumerate(TRICKY)] + [(4, "hello world"), (None, "hello world"), (90, "hello world"), (91, "tail ")]
    docs = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "doc_id long, text string, digest string, n long, pairs long")
    assert sorted(map(tuple, alignment.align(docs, hot_pairs=hot).collect()), key=str) == _brute(both, rows)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op12_against_brute_force(spark, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_alignment"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == _brute(both, rows)


def test_pieces_by_word_equal_whole_texts(both):
    rng = np.random.default_rng(3)
    encode = alignment.PieceEncoder(PATHS[1])
    signs = list("ab \n\n  .▁é漢\r\t") + ["the", "();\r", " ing"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(3000)] + [x for x in TRICKY if x]
    ids, cuts = encode(pa.array(texts))
    assert encode.by_word and [ids[s:e].tolist() for s, e in zip(cuts, cuts[1:])] == both[1].encode(texts)


# Whitening


def _exact(vectors):
    """Fit list, exact sums, and V in floating point from exact whole numbers."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * c - s) for c, s in zip(r, sums)] for r in fit]) / n
    return x, n, sums, y.T @ y / n


def _check(got, ids, vectors, components=16):
    x, n, sums, v = _exact(vectors)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, len(e))
    assert len(got) == k * len(ids) and set(got.component) == set(range(1, k + 1)) and set(got.n) == {n}
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for i, r in zip(ids, x)}
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    y = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(r, sums)]) for i, r in zip(ids, x)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = np.array([y[i] @ u[:, :k] / np.sqrt(e[:k]) for i in ids])
    sign = np.sign((wide * want).sum(0))
    assert np.allclose(wide * sign, want, atol=1e-7)
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, e[:k] / np.trace(v), rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_op13_against_exact_sums(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = queries.queries()["op13_whitening"](spark, SF).toPandas()
    _check(got, rows.vec_id.tolist(), rows.embedding.tolist())


def test_steep_and_flat_spectra(spark):
    rng = np.random.default_rng(1)
    for scales in (10.0 ** -np.linspace(0, 3, 60), np.ones(60), np.concatenate([np.full(3, 50.0), np.ones(57)])):
        vectors = (rng.normal(size=(500, 60)) * scales * 30).astype(np.float32).tolist()
        frame = spark.createDataFrame(list(zip(range(500), vectors)), "vec_id long, embedding array<float>")
        _check(whitening.whiten(frame).toPandas(), list(range(500)), vectors)


def test_odd_embeddings(spark):
    schema = "vec_id long, embedding array<double>, n long, v string, x string, component int"
    good = [(1, [0.0, 1.0, 2.0]), (2, [0.5, 1.5, 0.0]), (2, [0.5, 1.5, 0.0]), (None, [3.0, 0.0, 1.0]), (5, [0.0, 1.0, 2.0]), (6, [1.0, 4.0, -2.0]), (9, [-1.0, 0.0, 7.0])]
    odd = [(20, None), (21, []), (22, [None, 1.0, 1.0]), (23, [float("nan"), 1.0, 1.0]), (24, [float("inf"), 0.0, 0.0]), (25, [1.0]), (26, [1e300, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "", "", 2) for i, v in good + odd], schema)).toPandas()
    assert len(got) == 3 * len(good) and set(got.vec_id.dropna()) == {1, 2, 5, 6, 9} and set(got.n) == {5}
    named = got.dropna().drop_duplicates(["vec_id", "component"])
    assert len(named) == 15 and named.identity_error.iloc[0] < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", 1)] * 3, schema))
    assert same.count() == 0 and same.columns == [x.split()[0] for x in whitening.OUT.split(", ")]
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0, 2.0], 1, "", "", 1) for k in range(4)], schema)).toPandas()
    assert set(flat.component) == {1} and np.allclose(flat.explained, 1)
