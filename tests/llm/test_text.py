import gzip
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from quantpanel.llm import exact_dedup, language_id, license_scan, line_dedup, mixing, near_dedup, packing, queries, range_coder, token_output, tokens, warc
from quantpanel.llm.common import fresh_path

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]), with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, "x", 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one\ttwo"), (6, "onetwo"), (7, "A b c d e f g"), (7, "A b c d e f g"), (8, "word " * 20000), (9, "!!! 123")]


def test_exact_dedup(spark):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "idx"), 4)
    got = {r.doc_id: r for r in index.dedup(docs(spark, ODD)).collect()}
    assert got[4].keep_id == got[5].keep_id == got[6].keep_id == 4 and got[4].group_size == 3 and got[4].kept and not got[6].kept
    assert got[1].keep_id == got[2].keep_id == got[3].keep_id == 3  # the longest original stays
    again = index.dedup(docs(spark, [(20, "onetwo"), (21, "new")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(20, 4, False), (21, 21, True)}
    assert exact_dedup.DigestIndex(spark, index.path, 4).rows().count() == index.rows().count() == 6
    assert index.dedup(docs(spark, [])).count() == 0
    apart = exact_dedup.DigestIndex(spark, fresh_path(spark, "other") + "/" + index.path.rsplit("/", 1)[-1], 4)
    assert [(r.keep_id, r.kept) for r in apart.dedup(docs(spark, [(9, "onetwo")])).collect()] == [(9, True)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v
    rows = lambda f: sorted(str([plain(v) for v in r]) for r in f[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def _ids(encode, texts):
    ids, cuts = encode(pa.array(texts, pa.string()))
    return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_tokens_equal_whole_texts(kind, file):
    encode = tokens.Encoder(tokens.token_path(file), kind)
    texts = ["", "a  b", " x", "x ", "a\n\nb", "<|endoftext|> q", "it's, ok., é., x,", None, "\n", " ", "a \nb 'll 12345 tübe", "Word. word, Word.", "a b c d", "ab\x1cc"]
    want = [np.array([*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    assert _ids(encode, texts) == want == _ids(encode, texts)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 300, 5000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 500
    words = range_coder.encode_block(ids, 500)
    assert (range_coder.decode_block(words, n, 500) == ids).all()
    if n == 5000:
        assert words.nbytes < n * 2


def test_token_files(spark):
    folder = fresh_path(spark, "tok")
    rows = [r for r in ODD if r[0] != 7]
    token_output.write_tokens(docs(spark, rows), folder)
    got = token_output.read_tokens(spark, folder).orderBy("doc_id").collect()
    encode = tokens.Encoder(tokens.token_path("word_bpe_49k.json"), "word")
    want = _ids(encode, [r[1] for r in sorted(rows)])
    assert [bytes(r.ids) for r in got] == want
    assert [r.start for r in got] == [sum(len(w) // 4 for w in want[:k]) for k in range(len(want))]
    empty = fresh_path(spark, "tok")
    token_output.write_tokens(docs(spark, []), empty)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_token_file_detects_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    token_output.write_tokens(docs(spark, [(1, "some words here")]), folder)
    file = next((tmp_path / "t").glob("*.tok"))
    raw = bytearray(file.read_bytes())
    raw[30] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        token_output.read_tokens(spark, folder).collect()


def _check_packing(rows, texts, capacity=2048):
    encode = tokens.Encoder(tokens.token_path("byte_bpe_50k.json"), "byte")
    ids = dict(zip(texts, _ids(encode, list(texts.values())), strict=True))
    by_seq, held = {}, Counter()
    for r in rows:
        piece = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) // 4
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held.update({(r.doc_id, k): 1 for k in range(r.start, r.start + r.length)})
    assert set(held.values()) == {1} and len(held) == sum(len(x) // 4 for x in ids.values())
    used = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        used += at
    return 1 - used / (capacity * len(by_seq))


def test_packing(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.select("doc_id", "text").collect()}
    assert _check_packing(packing.pack(real).collect(), texts) < 0.01
    rows = [r for r in ODD if r[0] != 7]
    _check_packing(packing.pack(docs(spark, rows)).collect(), dict(rows))
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, ODD), keep_ids=True).where("octet_length(ids) <> 4 * length").count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    bins, free = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            bins.append([])
            free.append(100)
        bins[k].append(i)
        free[k] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == bins


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def _components(texts):
    sets, label = {i: _shingles(t) for i, t in texts}, {i: i for i, _ in texts}
    find = lambda x: x if label[x] == x else find(label[x])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_dedup_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    passage = " ".join(f"p{x}" for x in range(60))
    for k in range(150):
        words = base[k % 3].split()
        for at in rng.integers(0, len(words), int(rng.integers(0, 6))):
            words[at] = f"x{k}_{at}"
        rows.append((100 + k, " ".join(words)))
    rows += [(400 + k, passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 9000, int(rng.integers(10, 60))))) for k in range(60)]
    rows += [(600, None), (601, ""), (602, "A b"), (603, "a  B"), (604, "one"), (605, base[0]), (605, base[0]), (606, "word " * 3000)]
    want, sizes = _components({i: t for i, t in rows}.items())
    got = near_dedup.near_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got)
    assert near_dedup.near_components(docs(spark, [])).count() == 0
    edit = lambda t, k: " ".join(x if j != k else "edited" for j, x in enumerate(t.split()))
    longer = base[1] + " " + " ".join(f"more{k}" for k in range(4))
    rows = [(5, base[0]), (5, longer), (6, edit(base[0], 60)), (7, edit(longer, 60)), (None, base[0])]
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_components(docs(spark, rows)).collect()} == {(5, 5), (6, 6), (7, 5)}
    kept = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", longer), ("6", rows[2][1]), ("None", base[0])])


_LINE = r"(?<=\n)|(?<=[.!?] )"
_CUT = r"[぀-鿿] ?|[adgiloruADGILORU0369,;:).!?\x80-\U0010ffff] |\n"


def _split(pattern, text):
    return [u for u in re.split(pattern, text) if u]


def _twelve(unit):
    words = unit.split(" ")
    words = [w + " " for w in words[:-1]] + words[-1:]
    return [x for x in ("".join(words[k : k + 12]) for k in range(0, len(words), 12)) if x]


def _chunks(text):
    """Lists of units: cut behind every local minimum of a rolling hash over two units."""
    ends = [m.end() for m in re.finditer(_CUT, text)]
    units = [u for u in (text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])) if u]
    units = [part for u in units for part in (_twelve(u) if u.count(" ") > line_dedup.UNIT_WORDS else [u])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    r = [signed(x ^ ((h[i - 1] << 1) & (2**64 - 1) if i else 0)) for i, x in enumerate(h)]
    low = {i for i in range(2, len(r) - 1) if r[i] < r[i - 1] and r[i] < r[i + 1]} | ({len(r) - 1} if r else set())
    ends, held = [], 0
    for i in range(len(r)):  # at a minimum, or where a chunk is full
        held += 1
        if i in low or held == line_dedup.MAX_UNITS:
            ends, held = [*ends, i], 0
    begins = [0, *(e + 1 for e in ends)]
    return [units[b : e + 1] for b, e in zip(begins, ends)]


def _dedup_lines(rows):
    """text by doc_id after line dedup, by the definition alone: loops over one place after another."""
    docs = dict(sorted((i, t) for i, t in rows if t is not None))
    chunks = {i: _chunks(t) for i, t in docs.items()}
    count = Counter("".join(c) for cs in chunks.values() for c in cs)
    groups = {}
    for i, cs in chunks.items():
        twice = [count["".join(c)] > 1 for c in cs]
        at = 0
        while at < len(cs):
            end = at
            while end < len(cs) and twice[end]:
                end += 1
            if sum(map(len, cs[at:end])) >= line_dedup.CORE_UNITS:
                for k in range(at, end):
                    groups.setdefault((0, "".join(cs[k])), []).append((i, k, k, 0))
                after, before = [x for c in cs[end : end + 2] for x in c], [x for c in cs[max(0, at - 2) : at] for x in c]
                for j in range(1, 1 + min(len(after), line_dedup.GROWTH)):
                    over = j - len(cs[end])
                    groups.setdefault((1, "".join(cs[end - 1] + after[:j])), []).append((i, end - 1, end + (over > 0), over if over > 0 else j))
                for j in range(1, 1 + min(len(before), line_dedup.GROWTH)):
                    over = j - len(cs[at - 1])
                    groups.setdefault((2, "".join(before[-j:] + cs[at])), []).append((i, at, at - 1 - (over > 0), over if over > 0 else j))
            at = max(end, at + 1)
    state = {i: [[0] * len(c) for c in cs] for i, cs in chunks.items()}
    for (kind, _), places in groups.items():
        first = min(p[:2] for p in places)
        if len({p[:2] for p in places}) > 1:
            for i, source, at, n in places:
                own, value = state[i][at], 1 if (i, source) == first else 2
                for u in range(len(own)) if kind == 0 else range(n) if kind == 1 else range(len(own) - n, len(own)):
                    own[u] = max(own[u], value)
    out = {i: None for i, _ in rows}
    for i, cs in chunks.items():
        units, states, kept, at = [u for c in cs for u in c], [x for c in state[i] for x in c], [], 0
        while at < len(units):
            end = at
            while end < len(units) and states[end] == states[at]:
                end += 1
            text = "".join(units[at:end])
            fresh = at == 0 or re.search(r"(\n|[.!?] )\Z", units[at - 1])
            long = len(text.split()) >= line_dedup.MIN_WORDS or len(_split(_LINE, text)) - (0 if fresh else 1) >= 2
            kept += [] if states[at] == 2 and long else [text]
            at = end
        out[i] = "".join(kept)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(4)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9000, 8)) + ".\n"
    passage = "".join(line() for _ in range(14))
    rows = [(i, "".join(line() for _ in range(3)) + (passage if i % 2 else "") + "".join(line() for _ in range(3))) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "one line"), (53, "one line"), (54, passage), (54, passage), (55, "common.\n" + line() + line()), (56, "common.\n" + line())]
    rows += [(60 + i, " ".join(f"w{x}" for x in rng.integers(0, 60, 400))) for i in range(8)] + [(70, "word " * 5000), (71, "日本語の文章です。" * 9), (72, passage[:300] + passage[200:500]), (73, "a \x01b or c \x01 d. " * 3 + passage)]
    frame = docs(spark, rows)
    want = _dedup_lines(rows)
    got = line_dedup.dedup_lines(frame)
    assert set(frame.columns) < set(got.columns)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert sum(len(want[i]) < len(t) - 500 for i, t in rows if t and i % 2 and i < 12) == 5
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_equal_units(spark):
    """Runs of one line or one word, shared by texts that begin and end in other ways."""
    rng = np.random.default_rng(14)
    own = lambda n=4: " ".join(f"v{x}" for x in rng.integers(0, 9000, n))
    line = "the same line of forty-one characters...\n"
    rows = [(k, own(k + 3) + "\n" + line * 300 + own(5)) for k in (1, 2)] + [(k, own(k) + " " + "again " * 1700 + own(6)) for k in (3, 4)] + [(5, own(2) + " " + "ab cd " * 800 + own())]
    want = _dedup_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == want
    assert len(got[2]) < 120 and len(got[4]) < 120  # the later copy goes but for the units that its beginning shares
    assert all(own_end.split()[-1] in got[k] for k, own_end in rows)


def test_line_dedup_of_rests_of_long_units(spark):
    """Units are cut after twelve words; a rest of twelve words and an end looks like a whole unit, but is two."""
    rng = np.random.default_rng(21)
    words = lambda n: "".join(str(rng.choice(["th ", "ben ", "sh "])) for _ in range(n))
    shared = [words(12 * k) + "x\n" + words(int(rng.integers(20, 60))) + "ab.\n" for k in (1, 2, 3, 2)]
    rows = [(i, words(int(rng.integers(0, 30))) + "".join(shared[j] for j in rng.permutation(4)[:3]) + words(int(rng.integers(0, 14)))) for i in range(40)]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()} == _dedup_lines(rows)


def test_clashing_columns_stay(spark):
    rng = np.random.default_rng(15)
    text = " ".join(f"w{x}" for x in rng.integers(0, 9000, 80))
    names = ["h", "chunks", "key", "units", "sizes", "row", "marks", "guess", "runs", "made", "cut", "ends"]
    frame = spark.createDataFrame([(k, text + f" {k}", "en", *(f"{n}{k}" for n in names)) for k in range(6)], ["doc_id", "text", "lang", *names])
    for out in (line_dedup.dedup_lines(frame), language_id.identify(frame)):
        assert {r.doc_id: [r[n] for n in names] for r in out.collect()} == {k: [f"{n}{k}" for n in names] for k in range(6)}
    twice = language_id.identify(frame.withColumnsRenamed({"h": "score", "key": "lang_pred"}).withColumn("held_out", F.lit("x")))
    assert twice.columns.count("score") == twice.columns.count("lang_pred") == twice.columns.count("held_out") == 1 and dict(twice.dtypes)["score"] == "double"
    assert line_dedup.dedup_lines(frame.withColumnRenamed("h", "n_lines_removed")).columns.count("n_lines_removed") == 1


def test_rows_without_an_id(spark):
    rows = [(None, "only here"), (None, "onlyhere"), (None, "only here"), (7, "named too"), (None, "named  too"), (None, "namedtoo"), (3, "alone"), (None, "single")]
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "idx"), 2)
    got = index.dedup(docs(spark, rows)).collect()
    of = lambda text: [r for r in got if bytes(r.digest).hex() == __import__("hashlib").sha256(text.encode()).hexdigest()]
    assert len(got) == 8 and all(r.kept is not None for r in got)
    assert sum(r.kept for r in of("onlyhere")) == 1 and {(r.keep_id, r.group_size) for r in of("onlyhere")} == {(None, 3)}
    # the longest original stays though it has no id; with one length the named row stays
    assert [(r.doc_id, r.keep_id) for r in of("namedtoo") if r.kept] == [(None, None)] and len(of("namedtoo")) == 3
    equal = exact_dedup.DigestIndex(spark, fresh_path(spark, "idx"), 2).dedup(docs(spark, [(None, "a b"), (9, "a b"), (None, "a b")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in equal} == {(9, 9, True), (None, 9, False)}
    again = index.dedup(docs(spark, [(1, "only here"), (2, "alone"), (None, "fresh")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(1, None, False), (2, 3, False), (None, None, True)}


def test_token_files_keep_rows_without_an_id(spark):
    folder = fresh_path(spark, "tok")
    rows = [(None, "first one"), (5, "five"), (None, None), (-3, "minus"), (5, "five"), (5, "other five"), (None, "first one")]
    token_output.write_tokens(docs(spark, rows), folder)
    got = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -3, 5, 5, 5]
    encode = tokens.Encoder(tokens.token_path("word_bpe_49k.json"), "word")
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, _ids(encode, [t])[0]) for i, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()


def test_op8_against_the_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.token_path("word_bpe_49k.json"))
    start, want = 0, {}
    for i in sorted(rows):
        ids = [*whole.encode(rows[i] or "", add_special_tokens=False).ids, 1]
        want[i], start = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), start + len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.queries()["op8_token_output"](spark, SF).collect()} == want


def test_line_dedup_of_a_real_table(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = _dedup_lines([(r.doc_id, r.text) for r in real.collect()])
    assert {r.doc_id: r.text for r in queries.queries()["op5_line_dedup"](spark, SF).collect()} == want


TEMPLATE_ENDS = "this work is licensed under the gnu general public license version 2"


def test_license_scan(spark):
    rows = ODD + [(20, "Released under the MIT License."), (21, "gnu GENERAL-public license gnu general public license"), (22, "cc\nby"), (23, "licensed under CC BY-NC 4.0"), (24, "succ by"), (25, "All rights reserved."),
        (26, "Licensed under CC BY 4.0."), (27, "Part A is licensed under CC BY 4.0. Part B is licensed under CC BY-NC 4.0."), (28, "licensed under the GNU Lesser General Public License"),
        (29, "This work is licensed under the GNU General Public License version 3."), (30, "Released under the MIT License. Licensed under the Apache License, Version 2.0. All rights reserved.")]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[20].labels == "mit" and got[20].first_word == 3 and got[20].score == 1.0
    assert (got[21].n_base, got[21].first_word, got[21].last_word) == (2, 0, 4)
    assert got[22].base_labels == "cc-by" and got[24].base_labels == ""
    assert got[26].labels == "cc-by,cc-by-4.0" and got[27].labels == "cc-by,cc-by-4.0,cc-by-nc-4.0" and got[28].labels == "lgpl" and got[29].labels == "gpl,gpl-3"
    assert got[30].labels == "apache,apache-2.0,mit,reserved"
    assert got[23].labels == "cc-by,cc-by-nc-4.0" and got[25].labels == "reserved" and got[25].n_base == 0
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].score == 0.0
    assert license_scan.scan(docs(spark, [])).count() == 0
    apart = "redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    filler = " ".join(f"w{k}" for k in range(2000))
    rows = [(1, f"Licensed under the Apache License, Version 2.0. {apart} ok"), (2, apart), (3, f"released {filler} under {filler} the mit {filler} license"), (4, "licensed under the apache license version 2.0. All rights reserved."), (None, "this work is licensed under the gnu general public license version 3"), (None, "all rights reserved"), (5, filler + " " + TEMPLATE_ENDS + " " + filler)]
    got = sorted((str(r.doc_id), r.labels) for r in license_scan.scan(docs(spark, rows)).collect())
    assert got == [("1", "apache,apache-2.0,bsd"), ("2", "bsd"), ("3", ""), ("4", "apache,apache-2.0,reserved"), ("5", "gpl,gpl-2"), ("None", "gpl,gpl-3"), ("None", "reserved")]


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "abc"[i % 3] if i < 290 else None) for i in range(300)] + [(900, None, "en", "z"), (901, "x", "en", "a"), (901, "x", "en", "a")]
    frame = docs(spark, rows)
    got = mixing.copies(mixing.sized(frame)).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 7 and own[0].target <= 3 * own[0].source_size
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mixing.copies(mixing.sized(frame)).collect()}
    assert mixing.copies(mixing.sized(docs(spark, []))).count() == 0
    unique = docs(spark, rows[:300])
    assert mixing.mix(unique).count() == sum(r.copies for r in mixing.copies(mixing.sized(unique)).collect())


def test_language_id(spark):
    out = queries.queries()["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9 and out.score.between(0, 1).all()
    rows = [(i, ("the cat and dog " if i % 2 else "le chat et chien ") * 3, "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "", "en"), (102, "123 !?", "en"), (103, "the dog", None)]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[103].lang_pred == "en"
    assert {r.lang_pred for r in language_id.identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert language_id.identify(docs(spark, [])).count() == 0


def test_held_out_fold(spark):
    got = {r.doc_id: r.held for r in spark.range(200).withColumnRenamed("id", "doc_id").withColumn("held", language_id.held_out(F.col("doc_id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_warc(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", other)]
    folder = fresh_path(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {int(r.record_id.rsplit(":", 1)[1]): r for r in warc.read_warc(spark, folder).collect()}
    assert {k: r.record_type for k, r in got.items()} == {1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "response", 6: "response", 7: "response"}
    assert got[1].refers_to == "urn:x-page:3" and got[1].payload is None and got[1].payload_bytes == 1500 and got[2].target_uri is None
    assert bytes(got[7].payload).decode() == other and bytes(got[6].payload) == b"" and got[1].target_uri == "http://a/%20b"
    heads = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit'")
    assert heads.count() == 2 and all(r.payload is None for r in heads.collect())
    empty = fresh_path(spark, "w")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_appends_and_null_ids(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/w", "page_id long, url string, html string"
    warc.write_warc(spark.createDataFrame([(1, "u", "a"), (None, "u", "b" * 5000)], schema), folder)
    warc.write_warc(spark.createDataFrame([(2, "u", "c")], schema), folder)
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r.record_id, bytes(r.payload)[:2]) for r in got) == [("urn:x-page:1", b"a"), ("urn:x-page:2", b"c"), ("urn:x-page:null", b"bb")]
    file = max((tmp_path / "w").glob("*.warc.gz"), key=lambda f: f.stat().st_size)
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises(Exception, match="truncated archive"):
        warc.read_warc(spark, folder).collect()


def test_warc_of_other_origin(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    block = lambda kind, name, body, more=b"": b"WARC/1.0\r\nwarc-type: " + kind + b"\r\nWARC-Record-ID: <" + name + b">\r\n" + more + b"CONTENT-LENGTH: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    parts = [
        block(b"warcinfo", b"i", b"software: x\r\n"), block(b"response", b"a", http + b"page\r\n\r\nend", b"Content-Type: application/http;\r\n  msgtype=response\r\nWARC-Target-URI: http://a\r\n"),
        block(b"resource", b"b", b"z" * 3_000_000, b"Content-Type: text/plain\r\n"),
    ]
    want = [("a", "response", "http://a", b"page\r\n\r\nend"), ("b", "resource", None, b"z" * 3_000_000), ("i", "warcinfo", None, b"software: x\r\n")]
    for name, raw in (("plain.warc", b"".join(parts)), ("members.warc.gz", b"".join(map(gzip.compress, parts))), ("one.warc.gz", gzip.compress(b"".join(parts)))):
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_bytes(raw)
        got = warc.read_warc(spark, f"file://{folder}").collect()
        assert sorted((r.record_id, r.record_type, r.target_uri, bytes(r.payload)) for r in got) == want
        assert [r.payload_bytes for r in warc.read_warc(spark, f"file://{folder}", payload=False).where("record_type = 'response'").collect()] == [11]
        (folder / name).write_bytes(raw[: len(raw) // 2])
        with pytest.raises(Exception, match="truncated archive|not a WARC"):
            warc.read_warc(spark, f"file://{folder}").collect()


@pytest.mark.parametrize("n_words,sentences", [(50, 1), (50, 2), (60, 3), (80, 1), (80, 5)])
def test_line_dedup_cuts_short_passages(spark, n_words, sentences):
    rng = np.random.default_rng(n_words + sentences)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(2, 9))))
    rows, passages = [], []
    for p in range(20):
        words = [word() for _ in range(n_words)]
        for k in range(1, sentences):
            words[k * n_words // sentences - 1] += "."
        passages.append(" ".join(words))
        for d in (0, 100):
            around = [" ".join(word() for _ in range(40)) for _ in range(2)]
            rows.append((p + d, f"{around[0]} {passages[-1]} {around[1]}"))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[i] == t for i, t in rows if i < 100)
    cut = [len(t.split()) - len(got[i].split()) for i, t in rows if i >= 100]
    assert all(c <= n_words for c in cut) and sum(c >= n_words - 16 for c in cut) >= 18
    assert all(got[i].startswith(t[:200]) and got[i].endswith(t[-200:]) for i, t in rows if i >= 100)


def test_language_model_is_sparse_and_calibrated(spark):
    labelled = spark.read.parquet(f"{SF}/documents.parquet").where(~language_id.held_out(F.col("doc_id")))
    model = language_id.train(labelled)
    assert 0 < (model.table != 0).mean() < 0.25
    assert 1e-3 < model.temperature < 1e3
    z, y = np.array([[4.0, 0.0], [3.0, 0.0], [0.0, 5.0], [2.0, 0.0]]), np.array([0, 0, 1, 1])
    loss = lambda t: -np.log((e := np.exp(z / t))[np.arange(4), y] / e.sum(axis=1)).mean()
    best = language_id.fit_temperature(z, y, smoothing=0.0)
    assert loss(best) <= min(loss(best * 1.1), loss(best / 1.1))


def test_ftrl_against_plain_loop():
    rng = np.random.default_rng(3)
    ftrl = language_id.FTRL(6, 2, 0.5, 1.0, 0.05, 0.01)
    z, n = np.zeros((6, 2)), np.zeros((6, 2))
    for _ in range(40):
        at, x, y = rng.choice(6, 3, replace=False), rng.random(3), int(rng.integers(2))
        w = [[0.0 if abs(z[i, c]) <= 0.05 else -(z[i, c] - np.sign(z[i, c]) * 0.05) / ((1.0 + n[i, c] ** 0.5) / 0.5 + 0.01) for c in range(2)] for i in range(6)]
        s = [sum(x[k] * w[i][c] for k, i in enumerate(at)) for c in range(2)]
        p = [np.exp(v) / sum(np.exp(u) for u in s) for v in s]
        for k, i in enumerate(at):
            for c in range(2):
                g = x[k] * (p[c] - (c == y))
                z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / 0.5 * w[i][c]
                n[i, c] += g * g
        ftrl.step(at, x, y)
        assert np.allclose(ftrl.z, z) and np.allclose(ftrl.n, n)


def test_range_coder_beats_the_static_entropy():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    encode = tokens.Encoder(tokens.token_path("word_bpe_49k.json"), "word")
    ids = np.concatenate([encode(texts.slice(a, b - a))[0] for a, b in tokens.slices(texts, 4_000_000)])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    words = range_coder.encode_block(ids[: range_coder.BLOCK_IDS], 49409)
    assert words.nbytes * 8 / min(len(ids), range_coder.BLOCK_IDS) < -(share * np.log2(share)).sum() - 0.2
