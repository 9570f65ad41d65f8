import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from sievedeck.llm import lines, neardup, queries, substrings, textvec
from tests.llm.conftest import odd_rows, table


def copies(seed=11, n=60):
    """Documents that share passages, lines and whole texts, some many times."""
    r = random.Random(seed)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [say(r.randrange(15, 60)) for _ in range(4)]
    block = ["\n".join(say(6) for _ in range(r.randrange(2, 12))) for _ in range(3)]
    out = []
    for k in range(n):
        parts = [say(r.randrange(0, 40)), r.choice(passages), say(r.randrange(0, 12)), r.choice(block), say(r.randrange(0, 30)), r.choice(passages)]
        text = "\n".join(parts) if k % 2 else " ".join(parts)
        out.append((k * 7 % n, out[0][1] if k % 5 == 4 else text))
    return out


def slow_substrings(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(ws)
        for a in range(len(ws) - window + 1):
            key = tuple(ws[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept.split())
    return out


def unique_ids(rows):
    return list({i: (i, t) for i, t in rows if i is not None}.values())


def test_substrings_against_brute_force(spark, empty):
    for rows in (copies(), unique_ids(odd_rows()), copies(3, 90)):
        want = slow_substrings(rows)
        got = substrings.substring_dedup(table(spark, rows)).select("doc_id", "dedup.*").collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: x[:3] for i, x in want.items()}
        for r in got:
            assert re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") == want[r["doc_id"]][3]
            assert all(f["words"] >= 20 and (f["ref_doc"], f["ref_start"]) < (r["doc_id"], f["start"]) for f in r["factors"])
    assert substrings.substring_dedup(empty).collect() == []


def test_substrings_with_null_and_shared_ids(odd):
    rows = substrings.substring_dedup(odd).collect()
    assert len(rows) == odd.count()
    assert [r["dedup"]["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert {r["dedup"]["text"] for r in rows if r["text"] is None} == {None}


def slow_lines(rows):
    """By the definition, on Python strings; cuts come from the shared rolling hash of two lines."""
    def cuts(text):
        ls = text.split("\n")
        out = [False]
        for a, b in zip(ls, ls[1:], strict=False):
            data = np.frombuffer(f"{a}\n{b}".encode(), np.uint8)
            n = len(a.encode())
            h = textvec.span_hash(data, np.array([0, n + 1]), np.array([n, len(data)]))[0]
            out.append(bool(textvec.sequence_hash(h, 2)[0] % np.uint64(lines.MODULUS) == 0))
        return ls, out

    seen, out = {}, {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        if text is None:
            out[i] = (0, 0, None)
            continue
        ls, cut = cuts(text)
        parts, own = [], []
        for k, line in enumerate(ls):
            own.append(line)
            if cut[k] and len(own) >= 2 and len(ls) - k - 1 >= 2:
                parts.append(own)
                own = []
        parts.append(own)
        kept, removed = [], 0
        for p in parts:
            key = "\n".join(p)
            if len(p) > 1 and key in seen:
                removed += len(p)
            else:
                kept.append(key)
            if len(p) > 1:
                seen[key] = i
        out[i] = (len(ls), removed, "\n".join(kept))
    return out


def test_lines_against_brute_force(spark, empty):
    for rows in (copies(), unique_ids(odd_rows()), copies(4, 90)):
        got = lines.line_dedup(table(spark, rows)).collect()
        want = slow_lines(rows)
        assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in got} == want
        assert any(x[1] for x in want.values()) or len(rows) < 30
    assert lines.line_dedup(empty).collect() == []


def slow_passages(rows):
    """A line goes if it stands in two neighbouring lines that stand together earlier too."""
    seen, out = set(), {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        ls = (text or "").split("\n")
        gone = [False] * len(ls)
        for k in range(len(ls) - 1):
            if (ls[k], ls[k + 1]) in seen:
                gone[k : k + 2] = [True] * 2
            seen.add((ls[k], ls[k + 1]))
        out[i] = (0, 0, None) if text is None else (len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g))
    return out


def test_line_query_takes_whole_passages(spark, tmp_path):
    between = [(100 + k, "\n".join([f"before {k}", *(f"line {n} of passage {k // 2}" for n in range(2 + k // 2)), f"after {k}"])) for k in range(20)]
    for n, rows in enumerate((copies(), unique_ids(odd_rows()), copies(4, 90), between)):
        table(spark, rows).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_line_dedup(spark, f"{tmp_path}/{n}").collect()}
        want = slow_passages(rows)
        assert got == {i: (a, b, None if c is None else hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in want.items()}
    assert [got[100 + k][1] for k in range(20)] == [0 if k % 2 == 0 else 2 + k // 2 for k in range(20)]


def test_passages_of_odd_rows(odd, empty):
    out = lines.line_dedup(odd, passages=True).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r["doc_id"] for r in odd.collect())
    assert lines.line_dedup(empty, passages=True).collect() == []


def test_lines_keep_columns_and_odd_rows(odd):
    out = lines.line_dedup(odd, drop_emptied=True)
    assert set(out.columns) == {*odd.columns, "n_lines", "n_removed"}
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r["doc_id"] for r in odd.collect())


def test_chunks_resist_shifts():
    r = random.Random(1)
    body = ["".join(r.choice("abcdef ") for _ in range(20)) for _ in range(60)]
    cut = lambda text: {text[a:b] for a, b in zip(*(x.tolist() for x in lines.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[:2]), strict=True)}
    a, b = cut("\n".join(body).encode()), cut("\n".join(["x", *body]).encode())
    assert len(a & b) > 0.8 * len(a)
    assert pa.array([1]) is not None


def slow_near(rows, k, percent=80):
    """All pairs on Python sets, then components."""
    sets = {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed=2, groups=12):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    out = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 40, 200]))]
        for _ in range(r.randrange(1, 15)):
            text = list(base)
            for _ in range(r.randrange(0, 6) * len(base) // 100):
                text[r.randrange(len(text))] = r.choice(words)
            out.append(" ".join(text).upper() if r.random() < 0.2 else " ".join(text))
        chain = list(base)
        for _ in range(6):  # each near the one before, the ends apart
            for _ in range(max(1, len(chain) // 50)):
                chain[r.randrange(len(chain))] = r.choice(words)
            out.append(" ".join(chain))
    r.shuffle(out)
    return [(3 * i, t) for i, t in enumerate(out)]


def test_near_duplicates_against_brute_force(spark, empty):
    for rows, k in ((near_copies(), 4), (unique_ids(odd_rows()), 5), (near_copies(9, 20), 5)):
        got = neardup.near_duplicates(table(spark, rows), shingle_words=k).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == slow_near(rows, k)
    assert neardup.near_duplicates(empty).collect() == []


def test_near_duplicates_with_null_and_shared_ids(odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]


def test_odd_sketches_tell_high_similarities_apart():
    r = np.random.default_rng(4)
    for size in (3, 30, 400, 3000):
        for share, passes in ((0.8, True), (0.9, True), (0.55, False)):
            for _ in range(30):
                common = r.integers(0, 1 << 63, int(size * share), dtype=np.uint64) * np.uint64(2)
                extra = [r.integers(0, 1 << 63, x, dtype=np.uint64) * np.uint64(2) for x in ((size - len(common)) // 2, (size - len(common) + 1) // 2)]
                a, b = (np.unique(np.concatenate([common, e])) for e in extra)
                x, y = (neardup.odd_sketches(s, np.array([0, len(s)]))[0] for s in (a, b))
                ones = sum(int(v).bit_count() for v in x ^ y)
                if passes and len(common) >= 0.8 * size:
                    assert ones <= neardup.sketch_bounds(0.8)[int(np.floor(8 * np.log2(len(a) + len(b))))]
                elif not passes and size == 400:
                    assert ones > neardup.sketch_bounds(0.8)[int(np.floor(8 * np.log2(len(a) + len(b))))]
