import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_small_operators import ODD_ROWS, odd_docs

from framelake.llm import runs


def plain_runs(words):
    """Every lag's matches, word by word; a stretch counts with its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s - q, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def random_words(r):
    kind = r.random()
    if kind < 0.3:
        return [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 60))]
    if kind < 0.8:
        out = []
        for _ in range(r.randint(1, 4)):
            block = [r.randrange(3) for _ in range(r.randint(1, 9))]
            out += (block * r.randint(1, 8))[: r.randint(1, 70)] + [r.randrange(4) for _ in range(r.randint(0, 4))]
        return out
    return [r.randrange(40) for _ in range(r.randint(0, 200))]


def test_runs_equal_a_search_of_every_lag():
    r = random.Random(3)
    for _ in range(30):
        texts = [random_words(r) for _ in range(50)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = runs.runs_of(np.array([x for t in texts for x in t], np.int64), bounds)
        assert [tuple(x) for x in got.tolist()] == [(i, *x) for i, t in enumerate(texts) for x in plain_runs(t)]


def test_long_texts_take_little_work():
    assert runs.runs_of(np.zeros(300_000, np.int64), np.array([0, 300_000])).tolist() == [[0, 0, 300_000, 1]]
    assert runs.runs_of(np.tile(np.arange(25_000), 4), np.array([0, 100_000])).tolist() == [[0, 0, 100_000, 25_000]]
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(3, np.int64), np.array([0, 3]), times=3)


def plain_row(id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if id is not None and n:
        h = zlib.crc32(str(id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_its_definition_also_on_odd_rows(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join("abcdefgh"[x % 8] + "é" * (x // 8) for x in random_words(r)) for _ in range(300)]
    rows = list(enumerate(texts, 100)) + [(i, t) for i, t in ODD_ROWS if (t or "").count(" ") < 100] + [(7, "a a a a\ta a\n\x0ba a a a a a"), (30, " \t ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in runs.op12_runs(spark, str(tmp_path)).collect()]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    assert sorted(got, key=repr) == sorted((plain_row(*x) for x in rows), key=repr)
    assert len(runs.find(odd_docs(spark)).collect()) == len(ODD_ROWS)
    long = {x.doc_id: x for x in runs.find(odd_docs(spark)).collect()}[5]
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 1)] and long.collapsed == "long"
    assert runs.find(odd_docs(spark).limit(0)).collect() == []
