"""Inputs that weak hashes, shared ids and shared boilerplate would get wrong."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievedeck.llm import bpe, joins, lines, neardup, packing, queries, substrings, textvec, tokenstore
from tests.llm.conftest import table
from tests.llm.test_dedup import copies, slow_passages, slow_substrings

BYTE, WORD, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def thue_morse(n, a, b):
    """Two words of n letters, each letter of the one the other one's opposite: equal under polynomials modulo 2**64."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(5)
    filler = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(19))
    same, rows = filler(), []
    for n in (1024, 2048, 4096):
        for word in thue_morse(n, "a", "b"):
            rows += [(len(rows), word), (len(rows) + 1, f"{word} {same}")]
    a, b = ([f"{c}x" for c in word] for word in thue_morse(2048, "k", "l"))
    rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    return rows


def test_hashes_tell_thue_morse_words_apart(pairs):
    texts = [t.encode() for _, t in pairs[:-2] if " " not in t]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends, _ = textvec.words(data, np.array([0, len(data)]))
    for h in textvec.span_hash(data, starts, ends):
        assert len(set(h.tolist())) == len(texts)
    bits = np.array([k.bit_count() & 1 for k in range(4096)])
    items = np.concatenate([np.where(bits, 5, 9), np.where(bits, 9, 5)]).astype(np.uint64)
    for lane in (0, 1):
        for n in (64, 1024, 4096):
            h = textvec.range_hash(items, np.array([0, 4096]), np.array([n, 4096 + n]), lane)
            assert h[0] != h[1] and textvec.sequence_hash(items, n, lane)[0] != textvec.sequence_hash(items, n, lane)[4096]


def test_short_spans_have_hashes_of_their_own():
    r = random.Random(6)
    words = sorted({bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 40))) for _ in range(30000)} | {b"a" * n for n in range(1, 40)})
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    h = textvec.span_hash(data, starts, ends)
    assert len(set(h[0].tolist())) == len(set(h[1].tolist())) == len(words)
    again = textvec.span_hash(np.frombuffer(b"xx" + words[5] + b"yyyyyyyyyyyyyyyyyyy", np.uint8), np.array([2]), np.array([2 + len(words[5])]))
    assert (again[0][0], again[1][0]) == (h[0][5], h[1][5])


def test_thue_morse_tokens(spark, pairs):
    docs = table(spark, pairs)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for path, got in (
        (BYTE, packing.best_fit_packing(docs, BYTE, capacity=1 << 20)),
        (WORD, tokenstore.write_token_store(docs, WORD).statistics(4)),
    ):
        tok = Tokenizer.from_file(path)
        assert {r["doc_id"]: r["ids_crc32"] for r in got.collect()} == {i: crc(tok.encode(t, add_special_tokens=False).ids + [2]) for i, t in pairs}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {i: (sha(" ".join(map(str, own.encode_ordinary(t)))), sha(t)) for i, t in pairs}


def test_thue_morse_duplicates(spark, pairs):
    docs = table(spark, pairs)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.substring_dedup(docs).select("doc_id", "dedup.n_removed").collect()}
    assert got == {i: x[1] for i, x in slow_substrings(pairs).items()} and not any(got[i] for i, t in pairs[:-2])
    for k in (1, 4, 5):
        assert all(r["kept"] for r in neardup.near_duplicates(docs.where("doc_id % 2 = 0"), shingle_words=k).collect())
    stacked = [(i, f"{t}\nand\n{t}") for i, t in pairs[:-2]]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.line_dedup(table(spark, stacked), passages=True).collect()}
    assert got == slow_passages(stacked)


def by_places(rows, key=None):
    """The slow form for rows that share ids: documents in order of id and then of ``key``; equal rows are one place."""
    first, out = {}, []
    place = lambda r: (r[0], key(r))
    said = {}
    for r in sorted({r for r in rows}, key=place):
        ws = re.findall(r"[^\x20\x09-\x0D]+", r[1])
        said[r] = [tuple(ws[a : a + 20]) for a in range(len(ws) - 19)]
        for a, w in enumerate(said[r]):
            first.setdefault(w, (place(r), a))
    for r in rows:
        gone = set()
        for a, w in enumerate(said[r]):
            if first[w] != (place(r), a):
                gone |= set(range(a, a + 20))
        out.append((r[0], len(gone)))
    return collections.Counter(out)


def test_substrings_of_rows_that_share_an_id(spark):
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, long = say(60), say(200)
    rows = [(5, f"{say(30)} {passage} {say(10)}"), (5, say(4)), (5, long), (6, f"{passage} {say(100)}"), (6, passage), (5, long), (7, long[:500]), (7, "short"), (2, passage)]
    rows += [(3, t) for _, t in copies(5, 20)]
    df = table(spark, rows)
    order = {(x["doc_id"], x["text"]): x["h"] for x in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    got = substrings.substring_dedup(df).select("doc_id", "text", "dedup.*").drop("text").collect()
    assert collections.Counter((x["doc_id"], x["n_removed"]) for x in got) == by_places(rows, order.__getitem__)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    r = random.Random(9)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, z, other = say(60), say(70), say(50)
    rows = [(5, a), (5, z), (7, f"{a} word"), (9, f"{z} word"), (11, other), (12, other), (12, say(40)), (13, None), (13, "")]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 11: 11, 12: 11, 13: 13}


def test_boilerplate_gives_few_pairs(spark, monkeypatch):
    """Documents that share most of their text, each pair a little too different to link."""
    r = random.Random(3)
    frame = [f"b{k}" for k in range(400)]
    rows = []
    for i in range(2000):
        own = [f"u{i}x{k}" for k in range(r.randrange(74, 80))]
        rows.append((i, " ".join(frame[:200] + own + frame[200:])))
    near = [(5000 + i, rows[i][1].replace("b7 ", "c7 ")) for i in (3, 4)]
    verified = []
    slow = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: (verified.append(pairs.count()), slow(pairs, *rest))[1])
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows + near}
    assert sum(verified) < 20_000


def test_prefix_join_misses_nothing(spark):
    r = random.Random(12)
    sets = [set(r.sample(range(60), r.randrange(1, 40))) for _ in range(60)]
    sets += [s ^ set(r.sample(range(60), r.randrange(0, 4))) for s in sets]
    rows = [(i, 0, i, len(s), sorted(s)) for i, s in enumerate(sets) if s]
    df = spark.createDataFrame(rows, "v long, row long, c long, n long, items array<long>")
    for percent in (50, 80, 100):
        got = {tuple(sorted((x["a"], x["b"]))) for x in neardup.prefix_pairs(df, percent).collect()}
        want = {(i, j) for i, _, _, n, s in rows for j, _, _, m, t in rows if i < j and 100 * len(set(s) & set(t)) >= percent * len(set(s) | set(t))}
        assert want <= got


def test_common_shingles_against_sets():
    import pyarrow as pa

    r = random.Random(2)
    texts = ["", "a", "A b", *(" ".join(r.choice("abcdef") for _ in range(r.randrange(0, 30))) for _ in range(80))]
    for k in (1, 3, 5):
        def made(t):
            ws = t.lower().split()
            return {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())

        a, b = texts, texts[::-1]
        common, union = neardup.common_shingles(pa.array(a), pa.array(b), k)
        assert [(c, u) for c, u in zip(common.tolist(), union.tolist(), strict=True)] == [(len(made(x) & made(y)), len(made(x) | made(y))) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("passages", [True, False])
def test_colliding_line_hashes_change_nothing(spark, passages):
    df = table(spark, copies(6, 40))
    of = lambda how: sorted((r["doc_id"], r["n_removed"], r["text"]) for r in lines.line_dedup(df, passages=passages, how=how).collect())
    if passages:
        assert of(2) == of(lines.FAST)
    else:  # chunks are cut by a hash of their own
        assert of(2) == of(lines.FAST) == of(lines.SURE)


@pytest.mark.parametrize("name", ["__id", "__found", "__gone", "__made", "__row", "found"])
def test_columns_of_any_name(spark, name):
    df = spark.createDataFrame([(i, t, i) for i, t in copies(1, 12)], f"doc_id long, text string, `{name}` long")
    for out in (substrings.substring_dedup(df), lines.line_dedup(df), lines.line_dedup(df, passages=True), neardup.near_duplicates(df), queries.fingerprints.with_fingerprint(df)):
        assert out.count() == 12
    assert {r[name] for r in substrings.substring_dedup(df).collect()} == set(range(12))


def test_salted_join_is_the_join(spark):
    rows = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(3000)], "k long, x long")
    index = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("ref", rows["k"] + 1)
    got = joins.salted_join(rows, index, ["k"], ["x"]).select("k", "x", "n", "ref")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(index, "k").select("k", "x", "n", "ref").collect()))
    assert joins.salted_join(rows.limit(0), index.limit(0), ["k"], ["x"]).count() == 0


def test_long_words_as_the_library_encodes_them():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    d, r = bpe.DuckBpe(RANKS, public_tokenizers.PATTERN), random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (64, 65, 129, 1000, 100_000)]
    words += ["a" * 4097, "ab" * 700, "=" * 777, "\n" * 300, "é" * 500]
    words += ["".join(r.choice(["the", "ing", "er", "an", "tion", "ation", "u", "x", "é"]) for _ in range(r.randrange(20, 200))) for _ in range(200)]
    began = time.perf_counter()
    got = d.encode_words([w.encode() for w in words]).to_pylist()
    assert time.perf_counter() - began < 10
    assert got == [own._core_bpe.encode_single_piece(w.encode()) for w in words]
    assert d.decode(d.encode_words([w.encode() for w in words]))[0] == [w.encode() for w in words]


def test_word_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 200)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    r, d = random.Random(4), bpe.DuckBpe(RANKS, public_tokenizers.PATTERN)
    texts = [" ".join(f"word{r.randrange(40)}" for _ in range(r.randrange(0, 60))) for _ in range(60)] + [None]
    assert [(list(map(int, ids.split())), raw.decode()) for ids, raw in d.documents(texts)] == [(own.encode_ordinary(t or ""), t or "") for t in texts]


def test_piece_cache_that_overflows():
    import pyarrow as pa

    tok = Tokenizer.from_file(BYTE)
    encoder = textvec.PieceCache(textvec.library_encoder(BYTE).learn, max_entries=9, max_bytes=4000)
    r = random.Random(4)
    texts = [" ".join(f"word{r.randrange(40)}{'long' * r.randrange(9)}" for _ in range(r.randrange(0, 60))) for _ in range(60)]
    for a in range(0, 60, 5):
        for _, ids, offs in textvec.encode_documents(pa.array(texts[a : a + 5]), encoder):
            assert [ids[x:y].tolist() for x, y in zip(offs, offs[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts[a : a + 5]]


def test_pieces_whose_first_hashes_meet(monkeypatch):
    """Pieces are told apart by all they are known by, or by their bytes."""
    import pyarrow as pa

    plain = textvec.span_hash
    monkeypatch.setattr(textvec, "span_hash", lambda *x: (plain(*x)[0] % np.uint64(7), plain(*x)[1]))
    tok = Tokenizer.from_file(BYTE)
    encoder = textvec.PieceCache(textvec.library_encoder(BYTE).learn)
    r = random.Random(4)
    texts = [" ".join(f"word{r.randrange(400)}" for _ in range(r.randrange(0, 60))) for _ in range(60)]
    for a in range(0, 60, 5):
        for _, ids, offs in textvec.encode_documents(pa.array(texts[a : a + 5]), encoder):
            assert [ids[x:y].tolist() for x, y in zip(offs, offs[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts[a : a + 5]]
