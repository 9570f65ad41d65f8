import collections
import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievedeck.llm import bpe, packing, queries, textvec, tokenstore
from tests.llm.conftest import table

BYTE, WORD, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


@functools.lru_cache
def library(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def library_ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r ab1'sé,.  、　\x1ć", max_size=30), min_size=1, max_size=5))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_whole_texts(path, texts):
    import pyarrow as pa

    got = [ids[offs[k] : offs[k + 1]].tolist() for _, ids, offs in textvec.encode_documents(pa.array(texts), textvec.library_encoder(path)) for k in range(len(offs) - 1)]
    assert got == [library_ids(path, t) for t in texts]


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", " ", "\n", "a", "é", "|", "1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SPECIAL), max_size=9).map("".join), min_size=1, max_size=5))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_as_in_the_plain_library_call(path, texts):
    import pyarrow as pa

    plain = plain_library(path)
    got = [ids[offs[k] : offs[k + 1]].tolist() for _, ids, offs in textvec.encode_documents(pa.array(texts), textvec.library_encoder(path, True)) for k in range(len(offs) - 1)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@functools.lru_cache
def plain_library(path):
    return Tokenizer.from_file(path)


def test_token_queries_give_added_tokens_their_ids(spark, tmp_path):
    texts = ["abc <|endoftext|> def", "a  <|startoftext|>b", "<|endof", "text|> x", "plain"]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.op2_best_fit_packing(spark, str(tmp_path)).collect()}
    stored = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op4_token_store(spark, str(tmp_path)).collect()}
    for path, got in ((BYTE, packed), (WORD, stored)):
        want = [plain_library(path).encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert got == {k: (len(ids), crc(ids)) for k, ids in enumerate(want)}


def test_packing(odd):
    rows = packing.best_fit_packing(odd, BYTE, capacity=64).collect()
    docs = [(r["doc_id"], library_ids(BYTE, r["text"]) + [2]) for r in odd.collect()]
    want = collections.Counter((i, p, s, n, crc(ids[s : s + n])) for i, ids in docs for p, (s, n) in enumerate(packing.cut_points(len(ids), 64)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(len(ids) for _, ids in docs) // 64) + 1


def test_packing_of_nothing(empty):
    assert packing.best_fit_packing(empty, BYTE).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=12))
def test_histogram_packing_keeps_every_piece(counts):
    plan, got = packing.pack_histogram(counts, 32), collections.Counter()
    for combo, n in plan:
        assert sum(combo) <= 32
        for x in combo:
            got[x] += n
    assert got == collections.Counter(counts)


@functools.lru_cache
def fewest(left, capacity=20):
    """The least number of sequences for these lengths (descending), by trying every first sequence."""
    if not left:
        return 0

    def fills(at, room):
        yield ()
        for k in range(at, len(left)):
            if left[k] <= room:
                for more in fills(k + 1, room - left[k]):
                    yield (k, *more)

    best = len(left)
    for rest in set(fills(1, capacity - left[0])):
        best = min(best, 1 + fewest(tuple(x for k, x in enumerate(left) if k and k not in rest), capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_packing_against_the_optimum(lengths):
    plan = packing.pack_histogram(dict(collections.Counter(lengths)), 20)
    assert fewest(tuple(sorted(lengths, reverse=True))) <= sum(n for _, n in plan) <= fewest(tuple(sorted(lengths, reverse=True))) + 1


def test_exact_complements_leave_no_gap():
    plan = packing.pack_histogram({700: 5, 324: 5, 500: 2, 300: 2, 224: 2, 450: 1, 250: 1, 200: 1, 124: 1}, 1024)
    assert all(sum(c) == 1024 for c, _ in plan)


def test_token_store(odd, empty, tmp_path):
    store = tokenstore.write_token_store(odd, WORD, folder=str(tmp_path / "s"), rows_per_shard=4)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in store.statistics(4).collect())
    docs = [(r["doc_id"], library_ids(WORD, r["text"]) + [2]) for r in odd.collect()]
    assert got == collections.Counter((i, len(ids), crc(ids)) for i, ids in docs)
    rows = store.statistics(4).collect()
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    ids = [r["doc_id"] for r in ordered]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    shards = [tokenstore.Shard(str(p), store.dictionary) for p in (tmp_path / "s").glob("shard-*")]
    assert [x.tolist() for s in shards for x in s.find(25)] == [library_ids(WORD, odd.where("doc_id = 25").first()["text"]) + [2]]
    assert tokenstore.write_token_store(empty, WORD, folder=str(tmp_path / "e")).statistics(4).collect() == []


def test_dictionary_sample_comes_from_anywhere():
    n, places = tokenstore.SAMPLE_IDS, []
    for k in range(40):
        ids = np.random.default_rng(k).permutation(3 * n).astype("<u2")
        got = np.frombuffer(tokenstore.sample_block(ids.tobytes(), 2), "<u2")
        places.append(ids.tolist().index(int(got[0])))
        assert got.tolist() == ids[places[-1] : places[-1] + n].tolist()
    assert min(places) < n and max(places) > n
    assert tokenstore.sample_block(b"abcd", 2) == b"abcd"


def test_bpe_round_trip(odd, empty):
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in odd.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.bpe_round_trip(odd, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert bpe.bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).collect() == []
    both = bpe.bpe_decode(bpe.bpe_encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).select("text", "decoded").collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both)
